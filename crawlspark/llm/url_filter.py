"""URL rules by a blocked Bloom filter of the listed canonical keys and an exact hash join.

A rule is a host and a path prefix; it fits its host, all subdomains, and every path that starts
with its own. A URL's possible keys are its host's suffixes times its path's prefixes of the
lengths that occur in the list. The filter lets possible hits pass; they alone go on to the join
with the list, which removes false positives. The longest rule wins.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Blocks of 256 bits; with 2^15 of them (1 MB) 800,000 keys pass about 2 % of other keys. A larger list needs more.
BLOCKS = 1 << 15
_WORDS = 8  # 32-bit words of a block; each key sets one bit in each
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)  # fixed values: the usual odd salts of split-block filters
_SEED = 42  # of the session's xxhash64


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty if null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty if null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, verdict) of (verdict, host and path) pairs."""
    return spark.createDataFrame([(key, verdict) for verdict, key in rules], "key string, verdict string")


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and its one bit in each of the block's words."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return block.astype(np.int64), np.uint32(1) << ((low[:, None] * _SALTS) >> np.uint32(27))


def bloom(listed: DataFrame, blocks: int = BLOCKS) -> np.ndarray:
    """Filter over the keys, built by aggregation: tasks give masks, blocks are or-ed; at most ``blocks`` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bits = _bits(batch.column(0).to_numpy().view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *[pa.array(bits[:, k].astype(np.int64)) for k in range(_WORDS)]], names=["block", *(f"w{k}" for k in range(_WORDS))])

    masks = listed.select(F.xxhash64("key").alias("h")).mapInArrow(run, "block long, " + ", ".join(f"w{k} long" for k in range(_WORDS)))
    found = masks.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(_WORDS)]).toArrow()
    out = np.zeros((blocks, _WORDS), np.uint32)
    out[found.column(0).to_numpy()] = np.stack([found.column(k + 1).to_numpy() for k in range(_WORDS)], 1).astype(np.uint32) if found.num_rows else 0
    return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", blocks: int = BLOCKS) -> DataFrame:
    """The pages with host, path, rule and verdict.

    ``rules`` has key (host and path, like example.org/es/) and verdict; of rules that repeat a key
    the smaller verdict holds. Without a fitting rule the rule is null and the verdict the default.
    Defined results: a null url or one without :// has an empty host and path and the default
    verdict; equal rows are judged alike; columns of the new ones' names are replaced.
    """
    listed = rules.where(F.col("key").contains("/")).groupBy("key").agg(F.min("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in listed.select((F.length("key") - F.instr("key", "/") + 1).alias("n")).distinct().collect())  # distinct path lengths, not rules
    sent = pages.sparkSession.sparkContext.broadcast(bloom(listed, blocks))

    @F.pandas_udf("array<string>")
    def possible(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        owner, keys = [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            labels = host.split(".")
            for n in lengths:
                if n <= len(path):
                    found = [".".join(labels[i:]) + path[:n] for i in range(len(labels))]
                    owner += [k] * len(found)
                    keys += found
        out = [[] for _ in range(len(hosts))]
        if keys:
            block, bits = _bits(np.fromiter((xxhash.xxh64_intdigest(k.encode(), _SEED) for k in keys), np.uint64, len(keys)), blocks)
            for k in np.flatnonzero(((sent.value[block] & bits) == bits).all(1)):
                out[owner[k]].append(keys[k])
        return pd.Series(out)

    given = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*given, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_keys", possible("host", "path"))
    # a url's answer depends on its host and path alone, so only different ones meet the list
    hits = rows.where(F.size("_keys") > 0).select("host", "path", F.explode("_keys").alias("key")).distinct()
    best = hits.join(listed, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "best")
    out = rows.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.select(*given, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
