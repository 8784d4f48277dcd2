"""Trace as a file stream: running cost, live stagnation and budget, console, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crawlspark import markers as M
from crawlspark.operators import evidence as E
from crawlspark.operators import quality as Q
from crawlspark.operators import trace as TR
from crawlspark.plans.record_plan import typed_lines, verdicts
from crawlspark.sources import readers


def trace_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Append-only JSONL folder as a stream of trace events."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return readers.trace(reader.load(path))


def running_cost(events: DataFrame) -> DataFrame:
    """Token totals per run so far; write in update mode. State is one row per run."""
    return TR.token_totals(events)


def console(events: DataFrame) -> DataFrame:
    """Visible console lines of arriving events; stateless."""
    lines = events.select("domain", "run_id", "timestamp", TR.console_line(F.col("line")).alias("text"))
    return lines.where(F.col("text").isNotNull())


# --- stagnation and budget --------------------------------------------------

_STATE = "next_attempt long, fingerprint string, left long, waiting array<string>"
_OUTPUT = "run_id string, attempt long, stagnant boolean, attempts_left long, exhausted boolean"
_SEP = "\u001f"


def _run_attempts(max_attempts: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            nxt, last, left, waiting = state.get
        else:
            nxt, last, left, waiting = 1, None, max_attempts, []
        # Attempts are numbered from 1 within a run; one that arrives early waits its turn.
        queue = {}
        for text in waiting:
            number, sufficient, mark = text.split(_SEP, 2)
            queue[int(number)] = (sufficient == "1", mark)
        for pdf in batches:
            queue.update(
                (int(a), (bool(s), m)) for a, s, m in zip(pdf.attempt, pdf.sufficient, pdf.fingerprint)
            )
            rows = []
            while nxt in queue:
                sufficient, mark = queue.pop(nxt)
                if not sufficient and left > 0:
                    left -= 1
                rows.append((key[0], nxt, (not sufficient) and mark == last, left, left <= 0))
                last, nxt = mark, nxt + 1
            if rows:
                yield pd.DataFrame(
                    rows, columns=["run_id", "attempt", "stagnant", "attempts_left", "exhausted"]
                )
        early = [f"{a}{_SEP}{int(s)}{_SEP}{m}" for a, (s, m) in queue.items()]
        state.update((nxt, last, left, early))

    return step


def live_attempts(attempts: DataFrame, max_attempts: int = M.MAX_ATTEMPTS) -> DataFrame:
    """Stagnation and remaining budget as attempts arrive, per run.

    Keeps the last fingerprint, the budget and any attempt that came ahead of its turn.
    Equals the batch operators once every attempt has arrived.
    """
    facts = attempts.select(
        "run_id",
        F.col("attempt").cast("long").alias("attempt"),
        E.sufficient().alias("sufficient"),
        E.fingerprint().alias("fingerprint"),
    )
    return facts.groupBy("run_id").applyInPandasWithState(
        _run_attempts(max_attempts), _OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout
    )


# --- sinks ------------------------------------------------------------------


def append_batches(result: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write every micro-batch to its own folder, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    return (
        result.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Last update per key of an update-mode output."""
    updates = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch_id").alias("_v")
    ).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def check_record_sets(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str],
    required: Sequence[str] = M.REQUIRED_FIELDS,
    buckets: int = 64,
):
    """Validate arriving record lines with the batch operators; a set may spread over micro-batches.

    Every batch reads its own lines only, once, and keeps mergeable facts of them
    (``quality.line_chunks``) below ``path/facts``, in folders by hash of the set. It restates the
    verdict of the sets it brought lines of from all their facts so far, below ``path/reports``:
    ``latest`` gives the standing verdicts. A replayed batch replaces its own folders, so nothing
    counts twice. Blank and bad lines count as in ``validate_lines``.
    """
    columns = [*keys, "line_no", "line"]

    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        facts = Q.line_chunks(typed_lines(batch.select(*columns), keys), keys)
        kept = facts.withColumn("bucket", bucket).hint("rebalance", "bucket")
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/facts/batch={batch_id}")
        schema = facts.select("*").schema.add("batch", "long").add("bucket", "integer")
        log = spark.read.schema(schema).parquet(f"{path}/facts").where(F.col("batch") <= batch_id)
        touched = log.where(F.col("batch") == batch_id).select("bucket", *keys).distinct()
        touched = touched.select(*[F.col(c).alias(f"_key_{c}") for c in touched.columns])
        same = log["bucket"] == touched["_key_bucket"]
        for k in keys:
            same = same & log[k].eqNullSafe(touched[f"_key_{k}"])
        merged = Q.merge_chunks(log.join(touched, same, "left_semi"), keys)
        report = verdicts(Q.chunk_facts(merged, keys), keys, required=required)
        report.select(
            *keys, "passed", F.col("row_count").cast("long").alias("row_count"), "failure_category", "details",
            F.lit(batch_id).cast("long").alias("batch_id"),
        ).write.mode("overwrite").parquet(f"{path}/reports/batch={batch_id}")

    return (
        lines.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(check)
        .trigger(availableNow=True)
        .start()
    )
