"""Connected components by alternating stars: every step is a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlspark.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Every node of the edges (columns a, b, both long) with the smallest node it reaches.

    Returns (id, component_id); a node that is its own component's smallest is left out. Edges
    repeat or loop freely. Each round attaches the neighbours of a node to the smallest of them,
    first the larger ones and then the smaller ones, and is written to the shared folder. Rounds
    grow with the logarithm of the longest path; no group is ever gathered, a hub's edges meet
    its minimum in an equi-join.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = scratch.table(f"{name}-0", now)
    before, k = _mark(now), 0
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        k += 1
        now = scratch.table(f"{name}-{k}", small.union(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(f"{name}-{k - 1}")
        after = _mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0
