"""Training-order materialisation: a keyed Feistel permutation gives every sequence a slot, shards have a fixed stride.

Sequences of 2048 ids (see ``packing``) are numbered by split and place in it, inside a domain of
``SPLITS * CAPACITY`` numbers. A balanced Feistel network over the next even power of two, walked along its
cycle until it falls into the domain, permutes it, so any task computes a sequence's place in the
order for itself, without knowing how many there are; texts are tokenised once and ids cross one
shuffle. Equal ranges of the permuted domain are the shards. A task writes a shard's sequences in
order, each at rank * stride; the global slot is the number of sequences in the shards before,
plus the rank. A reader that knows its slot opens the shard at that byte and goes on.

Ids are unsigned 16-bit little-endian, short sequences padded. Shards are named by number and a
random part; only those listed by finished tasks count.
"""

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from crawlspark.llm.packing import LENGTH, rows, windows
from crawlspark.llm.scratch import Scratch

SHARD_SEQUENCES = 16_384
#: Most splits of an input, and most sequences of a split; more is an error.
SPLITS = 1 << 20
CAPACITY = 3_000_000
#: Bytes of text that make a token, roughly; only the number of shards follows from it.
_TOKEN_BYTES = 3
PADDING = 50_256
KEY = 2024
_ROUNDS = 4


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel(index: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """Slots of the numbers 0..size-1: a permutation keyed by ``key``."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        x = out[walking]
        left, right = x >> half, x & mask
        for k in range(_ROUNDS):
            left, right = right, left ^ (_round(right, key * _ROUNDS + k) & mask)
        x = (left << half) | right
        out[walking] = x
        walking[walking] = x >= size
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """(part, place, tokens, ids_crc32, packed): the packed sequences of each split, ids compressed for shuffle and disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pack, out = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1), []
        for place, (_, ids) in enumerate(windows(rows(batches), length, vocabulary)):
            if part >= SPLITS or place >= CAPACITY:
                raise ValueError(f"split {part} is beyond {SPLITS} or has more than {CAPACITY} sequences")
            data = ids.astype("<u2").tobytes()
            out.append((part, place, len(ids), zlib.crc32(data), pack.compress(data)))
            if len(out) >= 1024:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "part long, place long, tokens long, ids_crc32 long, packed binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def materialise(docs: DataFrame, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY, vocabulary: str | None = None) -> tuple[DataFrame, str]:
    """Write the documents' sequences in training order; one row per sequence, and the shards' folder.

    Rows: sequence_id (split and place), slot, shard, path, byte_offset, tokens, ids_crc32 (of the ids as
    written, without padding). Shards hold about ``shard_sequences`` sequences. Defined results: null and
    empty texts are the closing id alone; an empty table gives no shards. Columns other than doc_id and
    text are not read.
    """
    scratch = Scratch(docs.sparkSession, "training-order")
    domain = SPLITS * CAPACITY
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, -(-size // (_TOKEN_BYTES * length * shard_sequences)))

    @F.pandas_udf("long")
    def order_of(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), domain, key))

    placed = sequences(docs, length, vocabulary).withColumn("sequence_id", F.col("part") * CAPACITY + F.col("place"))
    placed = placed.withColumn("order", order_of("sequence_id"))
    placed = placed.withColumn("shard", F.floor(F.col("order") / -(-domain // shards)).cast("long"))
    placed = placed.select("sequence_id", "order", "shard", "tokens", "ids_crc32", "packed")
    dealt = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("order")
    folder = scratch.path("shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, out, path, rank = zstandard.ZstdDecompressor(), None, None, None, 0
        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        for batch in batches:
            paths, ranks = [], []
            for shard, packed in zip(batch.column(2).to_pylist(), batch.column(5), strict=True):
                if shard != now:
                    if out:
                        out.close()
                    now, rank, name = shard, 0, f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{inner}/{name}")
                ids = np.full(length, PADDING, "<u2")
                given = np.frombuffer(unpack.decompress(packed.as_py()), "<u2")
                ids[: len(given)] = given
                out.write(ids.tobytes())
                paths.append(path)
                ranks.append(rank)
                rank += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(paths, pa.string()), pa.array(ranks, pa.int64()), batch.column(3), batch.column(4)],
                names=["sequence_id", "shard", "path", "rank", "tokens", "ids_crc32"],
            )
        if out:
            out.close()

    written = dealt.mapInArrow(write, "sequence_id long, shard long, path string, rank long, tokens long, ids_crc32 long")
    written = scratch.table("written", written)
    per = written.groupBy("shard").agg(F.count("*").alias("n"))  # one row per shard
    per = per.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    out = written.join(per, "shard")
    offset = F.col("rank") * (2 * length)
    return out.select("sequence_id", (F.col("first") + F.col("rank")).alias("slot"), "shard", "path", offset.alias("byte_offset"), "tokens", "ids_crc32"), folder


def read_sequences(path: str, first: int, count: int, length: int = LENGTH) -> np.ndarray:
    """Ids of so many sequences of a shard, from the first-th on, read in one run."""
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as source:
        source.seek(first * length * 2)
        data = source.read(count * length * 2)
    return np.frombuffer(data, "<u2").reshape(-1, length)
