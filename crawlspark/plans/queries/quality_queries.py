"""Record-set validation over parts (records), events (lines) and documents (texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspark import markers as M
from crawlspark.functions import predicates as P
from crawlspark.operators import quality as Q
from crawlspark.plans.inputs import sql_any, table
from crawlspark.plans.record_plan import validate_lines
from crawlspark.plans.registry import query
from crawlspark.schema import RECORD_FIELDS
from crawlspark.session import shared_dir
from crawlspark.sources import sinks

_DAMAGE = M.MOJIBAKE[0]

# Parts are records and their brand is the record set. Nulls, foreign codes and damaged
# text come from the part's own size, type and brand.
_SQL_RECORDS = f"""
records AS (
  SELECT p_brand AS set_id, p_partkey AS line_no, p_name AS title,
    CASE WHEN p_brand LIKE '%3' AND p_size >= 25 THEN NULL WHEN p_size = 13 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS job_id,
    CASE WHEN p_size > 10 THEN p_type END AS city, CAST(NULL AS VARCHAR) AS state,
    CASE WHEN p_size > 20 THEN 'India' END AS country,
    CASE WHEN p_brand LIKE '%7' THEN NULL WHEN p_brand LIKE '%5' AND p_size = 50 THEN 'US'
      WHEN p_brand LIKE '%15' AND p_size = 49 THEN 'DE' ELSE 'IN' END AS country_code,
    'https://parts.example.com/jobs/' || p_partkey AS url, CAST(NULL AS VARCHAR) AS apply_url,
    CAST(NULL AS VARCHAR) AS date_posted, CAST(NULL AS VARCHAR) AS date_posted_text,
    CASE WHEN p_brand LIKE '%4' AND p_size = 7 THEN p_type || '{_DAMAGE}' ELSE p_type END AS job_description,
    CASE WHEN p_size < 40 THEN p_type END AS employment_type, CAST(NULL AS VARCHAR) AS work_type,
    CAST(NULL AS VARCHAR) AS salary_range FROM part)"""


def part_records(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size, brand, kind = F.col("p_size"), F.col("p_brand"), F.col("p_type")
    key = F.col("p_partkey").cast("string")
    records = part.select(
        brand.alias("set_id"),
        F.col("p_partkey").alias("line_no"),
        F.col("p_name").alias("title"),
        F.when(brand.endswith("3") & (size >= 25), None).when(size == 13, "").otherwise(key).alias("job_id"),
        F.when(size > 10, kind).alias("city"),
        F.when(size > 20, "India").alias("country"),
        F.when(brand.endswith("7"), None)
        .when(brand.endswith("5") & (size == 50), "US")
        .when(brand.endswith("15") & (size == 49), "DE")
        .otherwise("IN")
        .alias("country_code"),
        F.concat(F.lit("https://parts.example.com/jobs/"), key).alias("url"),
        F.when(brand.endswith("4") & (size == 7), F.concat(kind, F.lit(_DAMAGE))).otherwise(kind).alias("job_description"),
        F.when(size < 40, kind).alias("employment_type"),
    )
    return Q.complete_records(records, ["set_id", "line_no"])


# What the source claims to hold, and whether its script passed the static check.
_SQL_SETS = """
sets AS (SELECT p_brand AS set_id, count(*) + count(*) FILTER (p_size > 37) AS reported_total,
    p_brand NOT LIKE '%9' AS script_clean, p_brand <> 'Brand#8' AS output_found FROM part GROUP BY p_brand)"""


def part_sets(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("set_id")).agg(
        (F.count(F.lit(1)) + F.count_if(F.col("p_size") > 37)).alias("reported_total"),
        F.first(~F.col("p_brand").endswith("9")).alias("script_clean"),
        F.first(F.col("p_brand") != "Brand#8").alias("output_found"),
    )


def _sql_rate(f: str) -> str:
    return f"avg(CASE WHEN {f} IS NOT NULL THEN 1.0 ELSE 0.0 END)"


_ANY_DAMAGE = " OR ".join(f"coalesce({sql_any(f, M.MOJIBAKE)}, false)" for f in RECORD_FIELDS)
_SQL_REPORT = f"""WITH {_SQL_RECORDS}, {_SQL_SETS}, facts AS (
    SELECT set_id, count(*) AS n, {', '.join(f'{_sql_rate(f)} AS r_{f}' for f in M.REQUIRED_FIELDS)},
      list_sort(list_distinct(list(country_code) FILTER (country_code NOT IN ('IN')))) AS others,
      bool_or({_ANY_DAMAGE}) AS damaged FROM records GROUP BY set_id),
  judged AS (SELECT *, CASE WHEN NOT script_clean THEN 1 WHEN NOT output_found THEN 2
      WHEN n < reported_total * 0.8 THEN 3 WHEN r_title < 0.5 THEN 4 WHEN r_job_id < 0.5 THEN 5 WHEN r_url < 0.5 THEN 6
      WHEN len(others) > 0 THEN 7 WHEN damaged THEN 8 ELSE 9 END AS step FROM facts JOIN sets USING (set_id))
  SELECT set_id, step = 9 AS passed, CASE WHEN step <= 2 THEN 0 ELSE n END AS row_count,
    ['contains_regex', 'runtime_error', 'pagination_undercount', 'schema_drift', 'schema_drift', 'schema_drift',
     'zero_results_filter_mismatch', 'mojibake_encoding', NULL][step] AS failure_category,
    CASE step WHEN 1 THEN 'The script uses regular expressions.'
      WHEN 2 THEN 'No output was written.'
      WHEN 3 THEN 'Got ' || n || ' rows of ' || reported_total || '.'
      WHEN 4 THEN 'Required field ''title'' is missing in over half of the rows.'
      WHEN 5 THEN 'Required field ''job_id'' is missing in over half of the rows.'
      WHEN 6 THEN 'Required field ''url'' is missing in over half of the rows.'
      WHEN 7 THEN 'Rows of other countries: ' || array_to_string(others, ', ')
      WHEN 8 THEN 'Texts hold UTF-8 bytes read as Latin-1.' ELSE 'All checks passed.' END AS details,
    CASE WHEN step >= 7 THEN CAST(step > 7 AS VARCHAR) ELSE 'unknown' END AS all_allowed,
    round(CASE WHEN step >= 4 THEN r_job_id ELSE -1 END, 6) AS job_id_rate
  FROM judged"""


@query("record_set_report", _SQL_REPORT)
def record_set_report(spark, sf_dir):
    facts = Q.set_facts(part_records(spark, sf_dir), ["set_id"])
    joined = facts.join(part_sets(spark, sf_dir), "set_id", "left")
    report = Q.record_set_report(
        joined, F.col("reported_total"), F.col("script_clean"), F.col("output_found")
    )
    return report.select(
        "set_id",
        "passed",
        F.col("row_count").cast("long").alias("row_count"),
        "failure_category",
        "details",
        F.coalesce(F.col("all_country_code_allowed").cast("string"), F.lit("unknown")).alias("all_allowed"),
        F.round(F.coalesce(F.col("non_null_field_rates")["job_id"], F.lit(-1.0)), 6).alias("job_id_rate"),
    )


@query(
    "field_rates",
    f"WITH {_SQL_RECORDS} SELECT set_id, count(*) AS row_count, "
    + ", ".join(f"round({_sql_rate(f)}, 9) AS {f}" for f in RECORD_FIELDS)
    + " FROM records GROUP BY set_id",
)
def field_rates(spark, sf_dir):
    rates = Q.field_rates(part_records(spark, sf_dir), ["set_id"])
    return rates.select("set_id", "row_count", *[F.round(f, 9).alias(f) for f in RECORD_FIELDS])


_SQL_CONFIDENCE = f"""WITH {_SQL_RECORDS}, shared AS (SELECT * REPLACE (CASE WHEN job_id <> '' THEN title ELSE job_id END AS job_id) FROM records),
    rates AS (SELECT set_id, {', '.join(f'{_sql_rate(f)} AS r_{f}' for f in RECORD_FIELDS)} FROM shared GROUP BY set_id),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id, record_key ORDER BY line_no DESC) AS rn FROM (
      SELECT *, CASE WHEN coalesce(job_id, '') <> '' THEN job_id ELSE '_row_' || line_no END AS record_key FROM shared)) WHERE rn = 1),
    longform AS ({' UNION ALL '.join(f"SELECT set_id, record_key, '{f}' AS field, CASE WHEN {f} IS NOT NULL THEN r_{f} ELSE 0.0 END AS confidence FROM last JOIN rates USING (set_id)" for f in RECORD_FIELDS)})
    SELECT set_id, record_key, field, round(confidence, 9) AS confidence FROM longform"""


@query("field_confidence", _SQL_CONFIDENCE)
def field_confidence(spark, sf_dir):
    # Names repeat within a brand, so as job ids they make later records replace earlier ones.
    records = part_records(spark, sf_dir).withColumn(
        "job_id", F.when(F.col("job_id") != "", F.col("title")).otherwise(F.col("job_id"))
    )
    out = Q.field_confidence(records, ["set_id"], "line_no")
    return out.withColumn("confidence", F.round("confidence", 9))


@query("confidence_files", _SQL_CONFIDENCE)
def confidence_files(spark, sf_dir):
    """The confidence side files written and read back."""
    confidence, path = field_confidence(spark, sf_dir), shared_dir(spark, "confidence")
    sinks.write_confidence(confidence, path)
    return spark.read.schema(confidence.schema).json(path)


@query(
    "country_purity",
    f"""WITH {_SQL_RECORDS} SELECT set_id, coalesce(array_to_string(list_sort(list_distinct(list(country_code) FILTER (country_code IS NOT NULL))), ','), '') AS codes,
      coalesce(array_to_string(list_sort(list_distinct(list(country_code) FILTER (country_code <> 'IN'))), ','), '') AS offending,
      count(*) FILTER (country_code <> 'IN') = 0 AS all_allowed FROM records GROUP BY set_id""",
)
def country_purity(spark, sf_dir):
    purity = Q.country_purity(part_records(spark, sf_dir), ["set_id"])
    return purity.select(
        "set_id",
        F.array_join("codes", ",").alias("codes"),
        F.array_join("offending_codes", ",").alias("offending"),
        "all_allowed",
    )


@query(
    "country_filter",
    f"WITH {_SQL_RECORDS} SELECT set_id, line_no, title FROM records WHERE country_code = 'IN'",
)
def country_filter(spark, sf_dir):
    records = part_records(spark, sf_dir)
    return records.where(F.col("country_code") == M.DEFAULT_COUNTRY_CODE).select("set_id", "line_no", "title")


_DAMAGED = "CASE WHEN lang = 'fr' THEN replace(text, 'é', 'Ã©') WHEN lang = 'es' THEN replace(text, 'ñ', 'Ã±') ELSE text END"


@query(
    "mojibake_scan",
    f"""SELECT doc_id, {sql_any('text', M.MOJIBAKE)} AS raw_damaged, {sql_any(_DAMAGED, M.MOJIBAKE)} AS copy_damaged
      FROM documents""",
)
def mojibake_scan(spark, sf_dir):
    """The text as it is, and a copy with the accents of its language decoded wrongly."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    copy = (
        F.when(F.col("lang") == "fr", F.replace("text", F.lit("é"), F.lit("Ã©")))
        .when(F.col("lang") == "es", F.replace("text", F.lit("ñ"), F.lit("Ã±")))
        .otherwise(F.col("text"))
    )
    return docs.select(
        "doc_id", P.has_mojibake(F.col("text")).alias("raw_damaged"), P.has_mojibake(copy).alias("copy_damaged")
    )


# --- record lines -----------------------------------------------------------

_SQL_LINES = """
lines AS (
  SELECT user_id AS set_id, event_id AS line_no, CASE
    WHEN event_type = 'signup' THEN '  '
    WHEN event_type = 'error' AND value < 2 THEN '{"title": "cut'
    WHEN event_type = 'click' AND value < 1 THEN '{"title": "click", "job_id": ' || json_extract_string(props, '$.k') || '}'
    WHEN event_type = 'purchase' AND value < 0.5 THEN '[' || props || ']'
    ELSE '{"title": "' || event_type || '", "job_id": "' || event_id || '", "city": null, "extra": ' || props || '}' END AS line
  FROM events),
scanned AS (
  SELECT *, CASE WHEN json_valid(line) THEN coalesce(json_type(line) <> 'OBJECT', true)
    OR coalesce(json_type(line, '$.title') NOT IN ('VARCHAR', 'NULL'), false)
    OR coalesce(json_type(line, '$.job_id') NOT IN ('VARCHAR', 'NULL'), false) ELSE true END AS is_bad
  FROM lines WHERE trim(line) <> '')"""


def event_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind, value, props = F.col("event_type"), F.col("value"), F.col("props")
    k = F.try_variant_get(F.try_parse_json(props), "$.k", "string")
    line = (
        F.when(kind == "signup", "  ")
        .when((kind == "error") & (value < 2), '{"title": "cut')
        .when((kind == "click") & (value < 1), F.concat(F.lit('{"title": "click", "job_id": '), k, F.lit("}")))
        .when((kind == "purchase") & (value < 0.5), F.concat(F.lit("["), props, F.lit("]")))
        .otherwise(
            F.concat(
                F.lit('{"title": "'), kind, F.lit('", "job_id": "'), F.col("event_id").cast("string"),
                F.lit('", "city": null, "extra": '), props, F.lit("}"),
            )
        )
    )
    return e.select(F.col("user_id").alias("set_id"), F.col("event_id").alias("line_no"), line.alias("line"))


@query(
    "schema_drift_lines",
    f"""WITH {_SQL_LINES} SELECT set_id, line_no, is_bad, CASE WHEN NOT is_bad THEN json_extract_string(line, '$.title') END AS title,
      CASE WHEN NOT is_bad THEN json_extract_string(line, '$.job_id') END AS job_id FROM scanned""",
)
def schema_drift_lines(spark, sf_dir):
    scanned = Q.scan_lines(event_lines(spark, sf_dir))
    return scanned.select(
        "set_id", "line_no", "is_bad", F.col("record.title").alias("title"), F.col("record.job_id").alias("job_id")
    )


_SQL_LINE_REPORT = f"""WITH {_SQL_LINES}, numbered AS (
    SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY line_no) - 1 AS i FROM scanned),
  facts AS (SELECT set_id, min(i) FILTER (is_bad) AS bad_index, count(*) AS n FROM numbered GROUP BY set_id)
  SELECT set_id, CASE WHEN bad_index IS NULL THEN n ELSE 0 END AS row_count,
    CASE WHEN bad_index IS NULL THEN 'All checks passed.' ELSE 'Line ' || bad_index || ' does not parse as a record.' END AS details
  FROM facts"""


@query("record_lines_report", _SQL_LINE_REPORT)
def record_lines_report(spark, sf_dir):
    """Lines to verdict in one go; required fields are title and job_id here."""
    report = validate_lines(event_lines(spark, sf_dir), ["set_id"], required=("title", "job_id"))
    return report.select("set_id", F.col("row_count").cast("long").alias("row_count"), "details")


@query(
    "record_jsonl",
    f"""WITH {_SQL_RECORDS} SELECT set_id, line_no, '{{' || {" || ',' || ".join(
        f"'\"{f}\":' || coalesce(CAST(to_json({f}) AS VARCHAR), 'null')" for f in RECORD_FIELDS)} || '}}' AS line FROM records""",
)
def record_jsonl(spark, sf_dir):
    return part_records(spark, sf_dir).select("set_id", "line_no", sinks.record_line().alias("line"))


@query(
    "spot_check",
    f"""WITH {_SQL_RECORDS}, status AS (SELECT 'https://parts.example.com/jobs/' || p_partkey AS url,
      CASE WHEN p_size % 3 = 0 THEN 405 ELSE 200 END AS head_status, CASE WHEN p_size % 2 = 0 THEN 200 ELSE 404 END AS get_status
      FROM part WHERE p_size <> 17),
    sample AS (SELECT * FROM (SELECT set_id, url, row_number() OVER (PARTITION BY set_id ORDER BY line_no) AS rn FROM records) WHERE rn <= 3)
    SELECT set_id, bool_and(coalesce(head_status < 400 OR get_status < 400, false)) AS spot_check_ok
    FROM sample LEFT JOIN status USING (url) GROUP BY set_id""",
)
def spot_check(spark, sf_dir):
    size = F.col("p_size")
    status = table(spark, sf_dir, "part").where(size != 17).select(
        F.concat(F.lit("https://parts.example.com/jobs/"), F.col("p_partkey").cast("string")).alias("url"),
        F.when(size % 3 == 0, 405).otherwise(200).alias("head_status"),
        F.when(size % 2 == 0, 200).otherwise(404).alias("get_status"),
    )
    return Q.spot_check(part_records(spark, sf_dir), ["set_id"], "line_no", status)
