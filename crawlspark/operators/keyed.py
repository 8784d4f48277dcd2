"""Per-key building blocks that hold when one key owns a third of all rows.

* top rows of a key: the rank limit runs before the shuffle, so a task sends at most k
  rows of a key and the hot key's reducer gets k rows per task, not its whole group;
* running totals and previous rows: the key's rows are cut into chunks by their order
  column, chunks are worked on apart, and only one row per chunk meets its neighbours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_RANK = "_rank"
_CHUNK = "_chunk"
_IS_ROW = "_is_row"


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """The k first rows of every key; ``order`` must end in a tie-breaker."""
    column = rank or _RANK
    spec = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(column, F.row_number().over(spec)).where(F.col(column) <= k)
    return kept if rank else kept.drop(column)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key: duplicates go, first occurrence stays."""
    return top_k_per_key(df, keys, order, 1)


def span(order: Column, width: int) -> Column:
    """Chunk of a numeric order column: neighbours within ``width`` share a chunk."""
    return F.floor(order / F.lit(width))


def attach(df: DataFrame, heads: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join on ``names`` that also pairs NULL keys, with the key columns once."""
    renamed = heads.select(
        *[F.col(n).alias(f"_h_{n}") for n in names],
        *[F.col(c) for c in heads.columns if c not in names],
    )
    condition = F.lit(True)
    for n in names:
        condition = condition & df[n].eqNullSafe(renamed[f"_h_{n}"])
    return df.join(renamed, condition, "left").drop(*[f"_h_{n}" for n in names])


def _with_heads(keyed: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows and one head row per chunk together; a head sorts ahead of its chunk's rows.

    A union instead of a join: the rows are shuffled once, and NULL keys need no care.
    """
    return keyed.withColumn(_IS_ROW, F.lit(True)).unionByName(
        heads.withColumn(_IS_ROW, F.lit(False)), allowMissingColumns=True
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    totals: Mapping[str, Column],
) -> DataFrame:
    """Running sum, current row included, of each expression in ``totals``.

    ``chunk`` must not decrease along ``order``. Sums run inside (key, chunk), starting
    from the sum of the chunks before, which comes from one pre-aggregated row per chunk.
    """
    values = {f"_v_{n}": v for n, v in totals.items()}
    keyed = df.withColumn(_CHUNK, chunk).withColumns(values)
    by_chunk = [*keys, _CHUNK]
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*by_chunk).agg(*[F.sum(v).alias(v) for v in values])
    heads = sums.select(*by_chunk, *[F.sum(v).over(earlier).alias(v) for v in values])
    local = Window.partitionBy(*by_chunk).orderBy(_IS_ROW, *order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = _with_heads(keyed, heads).withColumns(
        {n: F.coalesce(F.sum(f"_v_{n}").over(local), F.lit(0)) for n in totals}
    )
    return summed.where(F.col(_IS_ROW)).drop(_CHUNK, _IS_ROW, *values)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, name: str
) -> DataFrame:
    """Number the rows of every key from 1 in order."""
    return running_totals(df, keys, order, chunk, {name: F.lit(1).cast("long")})


def previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    previous: Mapping[str, str],
    position: str | None = None,
) -> DataFrame:
    """Values of the row before, by output name; NULL on the first row of a key.

    ``position`` names a boolean column that tells a first row from a row whose
    predecessor holds NULL.
    """
    carried = F.struct(*[F.col(source).alias(name) for name, source in previous.items()])
    keyed = df.withColumn(_CHUNK, chunk).withColumn("_carried", carried)
    by_chunk = [*keys, _CHUNK]
    tails = keyed.groupBy(*by_chunk).agg(F.max_by("_carried", F.struct(*order)).alias("_carried"))
    heads = tails.withColumn(
        "_carried", F.lag("_carried").over(Window.partitionBy(*keys).orderBy(_CHUNK))
    ).where(F.col("_carried").isNotNull())
    local = Window.partitionBy(*by_chunk).orderBy(_IS_ROW, *order)
    both = _with_heads(keyed, heads).withColumn("_prev", F.lag("_carried").over(local))
    outputs = {name: F.col("_prev")[name] for name in previous}
    if position:
        outputs[position] = F.col("_prev").isNull()
    return both.where(F.col(_IS_ROW)).withColumns(outputs).drop(_CHUNK, _IS_ROW, "_carried", "_prev")
