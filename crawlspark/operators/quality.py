"""Validation of record sets: types, counts, null rates, purity, encoding, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crawlspark import markers as M
from crawlspark.functions import predicates as P
from crawlspark.functions.jsontext import is_json_object
from crawlspark.operators import keyed as K
from crawlspark.schema import RECORD, RECORD_FIELDS


def _rate(field: str) -> str:
    return f"_rate_{field}"


# --- lines ------------------------------------------------------------------


def mistyped_fields(line: Column, fields: Sequence[str] = RECORD_FIELDS) -> Column:
    """Declared fields whose JSON value is neither a string nor null; NULL if not an object.

    Reading straight into string columns would turn 5 into '5' and hide the drift.
    """
    entries = F.map_entries(F.from_json(line, "map<string,variant>"))
    wrong = F.filter(
        entries,
        lambda e: e["key"].isin(*fields)
        & ~F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")).isin("STRING", "VOID"),
    )
    return F.when(is_json_object(line), F.transform(wrong, lambda e: e["key"]))


def scan_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Non-blank JSONL lines with their parsed ``record`` and ``is_bad``."""
    typed = non_blank(lines, line).withColumn("_wrong", mistyped_fields(F.col(line)))
    return (
        typed.withColumn("is_bad", F.coalesce(F.size("_wrong") != 0, F.lit(True)))
        .withColumn("record", F.when(~F.col("is_bad"), F.from_json(F.col(line), RECORD)))
        .drop("_wrong")
    )


def non_blank(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.where(~F.col(line).rlike(r"^\s*$"))


# --- set-wide facts ---------------------------------------------------------


def complete_records(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """All record fields in order, absent ones as NULL text."""
    return df.select(
        *keep,
        *[
            (F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")).alias(f)
            for f in RECORD_FIELDS
        ],
    )


def field_rates(
    records: DataFrame, keys: Sequence[str], fields: Sequence[str] = RECORD_FIELDS
) -> DataFrame:
    """Row count and share of non-null values per field, one row per set."""
    sums = [F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in fields]
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *sums)


def set_facts(
    records: DataFrame,
    keys: Sequence[str],
    allowed: Sequence[str] = M.ALLOWED_COUNTRY_CODES,
    fields: Sequence[str] = RECORD_FIELDS,
) -> DataFrame:
    """Everything the verdict needs, in one aggregation that combines before its shuffle."""
    code = F.col("country_code")
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.avg(F.col(f).isNotNull().cast("double")).alias(_rate(f)) for f in fields],
        F.array_sort(F.collect_set(F.when(~code.isin(*allowed), code))).alias("offending_codes"),
        F.max(P.has_mojibake(*[F.col(f) for f in fields])).alias("has_mojibake"),
    )


def line_facts(
    typed: DataFrame,
    keys: Sequence[str],
    allowed: Sequence[str] = M.ALLOWED_COUNTRY_CODES,
    fields: Sequence[str] = RECORD_FIELDS,
    line_no: str = "line_no",
    width: int = 8192,
) -> DataFrame:
    """``set_facts`` of scanned lines plus ``bad_at``, the first bad line's number, and ``lines_ahead``, the lines before it.

    Lines are read once, into ``line_chunks``, and these are summed per set. Blank lines are not in
    ``typed`` and don't count; lines without a number have no place ahead of others; equal numbers are
    not ahead of each other.
    """
    return chunk_facts(line_chunks(typed, keys, allowed, fields, line_no, width), keys, fields)


def line_chunks(
    typed: DataFrame,
    keys: Sequence[str],
    allowed: Sequence[str] = M.ALLOWED_COUNTRY_CODES,
    fields: Sequence[str] = RECORD_FIELDS,
    line_no: str = "line_no",
    width: int = 8192,
) -> DataFrame:
    """Mergeable facts of scanned lines, one row per set and ``width`` line numbers.

    So one set with a third of all lines spreads over all tasks. A chunk keeps the numbers of its lines,
    four bytes each, to count those ahead of its first bad line.
    """
    number, code = F.col(line_no), F.col("country_code")
    rows = typed.withColumn("_chunk", K.span(number, width))
    offset = (number - F.col("_chunk") * width).cast("int")
    return rows.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(number).alias("_numbered"),
        *[F.count(F.col(f)).alias(f"_n_{f}") for f in fields],
        F.array_sort(F.collect_set(F.when(~code.isin(*allowed), code))).alias("_codes"),
        F.max(P.has_mojibake(*[F.col(f) for f in fields])).alias("_mojibake"),
        F.min(F.when(F.col("is_bad"), number)).alias("_bad"),
        F.min(F.when(F.col("is_bad"), offset)).alias("_bad_offset"),
        F.collect_list(offset).alias("_offsets"),
    )


def merge_chunks(parts: DataFrame, keys: Sequence[str], fields: Sequence[str] = RECORD_FIELDS) -> DataFrame:
    """Chunks of several reads of a set as one row each."""
    return parts.groupBy(*keys, "_chunk").agg(
        *[F.sum(c).alias(c) for c in ("_rows", "_numbered", *[f"_n_{f}" for f in fields])],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_codes")))).alias("_codes"),
        F.max("_mojibake").alias("_mojibake"),
        F.min("_bad").alias("_bad"),
        F.min("_bad_offset").alias("_bad_offset"),
        F.flatten(F.collect_list("_offsets")).alias("_offsets"),
    )


def chunk_facts(chunks: DataFrame, keys: Sequence[str], fields: Sequence[str] = RECORD_FIELDS) -> DataFrame:
    """``line_facts`` from chunks, each there once; a window sees one short row per chunk."""
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.expr("size(filter(_offsets, o -> o < _bad_offset))")
    placed = chunks.withColumn("_inside", F.when(F.col("_bad").isNotNull(), inside)).drop("_offsets").withColumn(
        "_ahead", F.coalesce(F.sum("_numbered").over(before), F.lit(0)) + F.col("_inside")
    )
    first_bad = F.min(F.when(F.col("_bad").isNotNull(), F.struct("_bad", "_ahead")))
    return placed.groupBy(*keys).agg(
        F.sum("_rows").alias("row_count"),
        *[(F.sum(f"_n_{f}") / F.sum("_rows")).alias(_rate(f)) for f in fields],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_codes")))).alias("offending_codes"),
        F.max("_mojibake").alias("has_mojibake"),
        first_bad.alias("_first_bad"),
    ).withColumns(
        {"bad_at": F.col("_first_bad")["_bad"], "lines_ahead": F.col("_first_bad")["_ahead"]}
    ).drop("_first_bad")


def rates_map(fields: Sequence[str] = RECORD_FIELDS) -> Column:
    return F.create_map(*[x for f in fields for x in (F.lit(f), F.col(_rate(f)))])


def country_purity(
    records: DataFrame,
    keys: Sequence[str],
    code: str = "country_code",
    allowed: Sequence[str] = M.ALLOWED_COUNTRY_CODES,
) -> DataFrame:
    """Distinct codes of a set against the allowed ones; a set without codes is pure."""
    codes = records.groupBy(*keys).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    offending = F.array_except("codes", F.array(*[F.lit(c) for c in allowed]))
    return codes.withColumn("offending_codes", F.array_sort(offending)).withColumn(
        "all_allowed", F.size("offending_codes") == 0
    )


# --- verdict ----------------------------------------------------------------


def record_set_report(
    facts: DataFrame,
    reported_total: Column | None = None,
    script_clean: Column | None = None,
    output_found: Column | None = None,
    bad_index: Column | None = None,
    required: Sequence[str] = M.REQUIRED_FIELDS,
    fields: Sequence[str] = RECORD_FIELDS,
) -> DataFrame:
    """Verdict per set: the first failing check decides category and detail."""
    yes = F.lit(True)
    clean = yes if script_clean is None else F.coalesce(script_clean, yes)
    found = yes if output_found is None else F.coalesce(output_found, yes)
    bad = F.lit(None).cast("bigint") if bad_index is None else bad_index
    total = F.lit(None).cast("bigint") if reported_total is None else reported_total
    n = F.coalesce(F.col("row_count"), F.lit(0))

    checks: list[tuple[Column, str, Column, int]] = [
        (~clean, "contains_regex", F.lit("The script uses regular expressions."), 0),
        (~found, "runtime_error", F.lit("No output was written."), 0),
        (bad.isNotNull(), "schema_drift", F.concat(F.lit("Line "), bad.cast("string"), F.lit(" does not parse as a record.")), 0),
        (n == 0, "zero_results_parsing_bug", F.lit("The output holds no record."), 0),
        (
            F.coalesce(n < total * M.UNDERCOUNT_RATIO, F.lit(False)),
            "pagination_undercount",
            F.concat(F.lit("Got "), n.cast("string"), F.lit(" rows of "), total.cast("string"), F.lit(".")),
            1,
        ),
    ]
    for f in required:
        checks.append(
            (
                F.col(_rate(f)) < M.REQUIRED_FIELD_RATE,
                "schema_drift",
                F.lit(f"Required field '{f}' is missing in over half of the rows."),
                2,
            )
        )
    checks += [
        (
            F.size("offending_codes") > 0,
            "zero_results_filter_mismatch",
            F.concat(F.lit("Rows of other countries: "), F.array_join("offending_codes", ", ")),
            3,
        ),
        (
            F.col("has_mojibake"),
            "mojibake_encoding",
            F.lit("Texts hold UTF-8 bytes read as Latin-1."),
            3,
        ),
    ]

    def pick(values: Sequence[Column], otherwise: Column) -> Column:
        chosen = None
        for (failed, *_), value in zip(checks, values):
            chosen = F.when(failed, value) if chosen is None else chosen.when(failed, value)
        return chosen.otherwise(otherwise)

    # How far the checks got decides which facts the report may show.
    reached = pick([F.lit(level) for *_, level in checks], F.lit(3))
    category = pick([F.lit(c) for _, c, _, _ in checks], F.lit(None).cast("string"))
    details = pick([d for _, _, d, _ in checks], F.lit("All checks passed."))
    return facts.withColumns(
        {
            "failure_category": category,
            "details": details,
            "_reached": reached,
            "all_country_code_allowed": F.when(reached >= 3, F.size("offending_codes") == 0),
        }
    ).withColumns(
        {
            "passed": F.col("failure_category").isNull(),
            "row_count": F.when(F.col("_reached") >= 1, n).otherwise(F.lit(0)),
            "non_null_field_rates": F.when(F.col("_reached") >= 2, rates_map(fields)),
        }
    ).drop("_reached", "offending_codes", "has_mojibake", *[_rate(f) for f in fields])


def spot_check(
    records: DataFrame,
    keys: Sequence[str],
    position: str,
    statuses: DataFrame,
    url: str = "url",
    sample_size: int = 3,
) -> DataFrame:
    """First records of a set against stored answers (url, head_status, get_status).

    The GET answer counts when HEAD was refused; an unknown URL fails; a sample without
    any URL passes.
    """
    sample = K.top_k_per_key(
        records.select(*keys, position, url), keys, [F.col(position)], sample_size
    )
    answers = statuses.select(F.col(url).alias("_url"), "head_status", "get_status")
    checked = sample.join(answers, sample[url] == F.col("_url"), "left")
    ok = P.responded(F.col("head_status")) | P.responded(
        F.when(F.col("head_status").isNotNull(), F.col("get_status"))
    )
    counted = F.when(F.coalesce(F.col(url), F.lit("")) != "", ok)
    return checked.groupBy(*keys).agg(F.coalesce(F.min(counted), F.lit(True)).alias("spot_check_ok"))


# --- confidence sidecar -----------------------------------------------------


def record_key(job_id: Column, position: Column) -> Column:
    """Job id, or the row position when there is none."""
    return F.when(F.coalesce(job_id, F.lit("")) != "", job_id).otherwise(
        F.concat(F.lit("_row_"), position.cast("string"))
    )


def field_confidence(
    records: DataFrame,
    keys: Sequence[str],
    position: str,
    fields: Sequence[str] = RECORD_FIELDS,
) -> DataFrame:
    """Per record key and field: the set-wide rate where a value is present, else 0.

    A key that occurs twice keeps its last record. Rates come from all records.
    """
    rates = records.groupBy(*keys).agg(
        *[F.avg(F.col(f).isNotNull().cast("double")).alias(_rate(f)) for f in fields]
    )
    present = records.select(
        *keys,
        F.col(position).alias("_pos"),
        record_key(F.col("job_id"), F.col(position)).alias("record_key"),
        *[F.col(f).isNotNull().alias(f) for f in fields],
    )
    last = K.first_per_key(present, [*keys, "record_key"], [F.col("_pos").desc()])
    joined = K.attach(last, rates, keys)
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.when(F.col(f), F.col(_rate(f))).otherwise(F.lit(0.0)).alias("confidence"),
            )
            for f in fields
        ]
    )
    return joined.select(*keys, "record_key", F.inline(pairs))
