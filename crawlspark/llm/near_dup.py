"""Near duplicates by HyperMinHash: banded compressed registers, corrected estimates, checks on full sets.

A document's set holds its distinct five-word shingles. Two documents are linked when
100 * intersection >= 75 * union. What is linked is found in two passes:

1. every set is sketched in 128 registers of 16 bits; bands of four registers put similar sets
   into buckets. In each bucket every member is held against one hub, the member that shares most
   buckets with others (the original among its edited copies), so a bucket of m members gives
   m - 1 pairs;
2. buckets whose members are still in several components are searched whole, for pairs across
   components. Estimates name the members that may link; only their texts come to the bucket, and
   the pairs are checked there on full sets, so no list of pairs leaves a task. Buckets of more
   than ``TILE`` members are dealt to tasks as pairs of tiles.

Estimates only sort out pairs at least four standard deviations below the threshold; every link
is confirmed on both full sets. A band of similarity 0.75 agrees with chance 0.32, so a link is
met in none of 32 bands with chance 5e-6; sets of a few shingles share bands more surely still.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from crawlspark.llm.components import components
from crawlspark.llm.scratch import Scratch
from crawlspark.llm.shingles import BAND, REGISTERS, WordHashes, estimate, fingerprint, jaccard_at_least, shingle_set, sketch

PERCENT = 75
DEVIATIONS = 4.0
TILE = 1024
SETS_BYTES = 32 << 20  # of decoded sets that a task keeps
_BANDS = REGISTERS // BAND
_SKETCHES = "doc_id long, n_shingles long, f1 long, f2 long, sketch binary"


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, two halves of a set fingerprint, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, f1, f2, registers = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), hashes)
                a, b = fingerprint(s)
                n.append(len(s)), f1.append(a), f2.append(b), registers.append(sketch(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(registers, pa.binary())],
                names=["doc_id", "n_shingles", "f1", "f2", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _SKETCHES)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold.

    ``texts`` has doc_id and the packed text. Only the texts of paired documents meet here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack, known = WordHashes(), zstandard.ZstdDecompressor(), {}

        def full(packed: bytes) -> np.ndarray:
            if packed not in known:
                if len(known) >= 32:
                    known.clear()
                known[packed] = shingle_set(unpack.decompress(packed), hashes)
            return known[packed]

        for batch in batches:
            a, b, ta, tb = batch.columns
            held = [jaccard_at_least(full(x.as_py()), full(y.as_py()), PERCENT) for x, y in zip(ta, tb, strict=True)]
            keep = pa.array(held, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text, compressed for the way through shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([pack.compress(t.as_py()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["doc_id", "packed"])

    plain = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return plain.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, packed binary")


def _likely(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs whose estimate may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_may_link(_registers(batch.column(4)), _registers(batch.column(5)), _numbers(batch.column(2)), _numbers(batch.column(3))))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = rows.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = rows.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, REGISTERS).astype(np.uint16)


def _may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    p = PERCENT / 100
    value, filled = estimate(a, b, (na + nb) / 2)
    near = value >= p - DEVIATIONS * np.sqrt(p * (1 - p) / np.maximum(filled, 1))
    return near & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by bucket as tables of whole buckets, with the row ranges of the buckets of two rows or more."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = _numbers(table.column("bucket"))
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on in the next batch
        rest = table.slice(last)
        if last:
            yield table.slice(0, last).combine_chunks(), _ranges(keys[:last])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), _ranges(_numbers(rest.column("bucket")))


def _ranges(keys: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    ends = np.append(starts[1:], len(keys))
    return [(int(lo), int(hi)) for lo, hi in zip(starts, ends, strict=True) if hi - lo > 1]


def _across(members: DataFrame) -> DataFrame:
    """Those bucket members that may link across components, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ranges in _buckets(batches):
            doc, comp, side, band, size = (_numbers(table.column(c)) for c in ("doc_id", "component_id", "side", "band", "n_shingles"))
            registers = _registers(table.column("sketch"))
            found = np.zeros(table.num_rows, bool)
            waiting, held = [], 0

            def judge() -> None:
                i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
                a, b = registers[i], registers[j]
                keep = _may_link(a, b, size[i], size[j])
                i, j, a, b = i[keep], j[keep], a[keep], b[keep]
                # a pair counts in the first band it shares, not in each
                equal = (a == b).reshape(-1, _BANDS, BAND).all(2) & (a != 0).reshape(-1, _BANDS, BAND).any(2)
                own = equal.argmax(1) == band[i]
                found[i[own]] = found[j[own]] = True

            for lo, hi in ranges:
                for pair in _pairs(lo, hi, comp, side):
                    waiting.append(pair)
                    held += len(pair[0])
                    if held >= 50_000:
                        judge()
                        waiting, held = [], 0
            if waiting:
                judge()
            yield from table.filter(pa.array(found)).to_batches()

    return members.mapInArrow(run, members.schema)


def _linked(members: DataFrame) -> DataFrame:
    """Links across components within each bucket, found on full sets; those that join nothing new are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor()
        for table, ranges in _buckets(batches):
            doc, comp, side, size = (_numbers(table.column(c)) for c in ("doc_id", "component_id", "side", "n_shingles"))
            registers, packed = _registers(table.column("sketch")), table.column("packed")
            links = []
            for lo, hi in ranges:
                sets: dict[int, np.ndarray] = {}
                room = SETS_BYTES

                def full(k: int) -> np.ndarray:
                    nonlocal room
                    if k not in sets:
                        if room < 0:
                            sets.clear()
                            room = SETS_BYTES
                        sets[k] = shingle_set(unpack.decompress(packed[k].as_py()), hashes)
                        room -= sets[k].nbytes
                    return sets[k]

                own = comp[lo:hi].copy()
                for i, other in ((i[0], j) for i, j in _pairs(lo, hi, comp, side)):
                    other = other[_may_link(np.broadcast_to(registers[i], (len(other), REGISTERS)), registers[other], size[i], size[other])]
                    for j in other:
                        x, y = own[i - lo], own[j - lo]
                        if x != y and jaccard_at_least(full(i), full(j), PERCENT):
                            links.append((doc[i], doc[j]))
                            own[own == max(x, y)] = min(x, y)
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _pairs(lo: int, hi: int, comp: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a bucket's rows that lie in different components, a row of the square at a time.

    side 0: all pairs of the bucket; 1 and 2: a pair of tiles, only pairs from one to the other.
    """
    rows = np.arange(lo, hi)
    one, two = (rows, rows) if side[lo] == 0 else (rows[side[lo:hi] == 1], rows[side[lo:hi] == 2])
    for k, i in enumerate(one):
        other = two[k + 1 :] if side[lo] == 0 else two
        other = other[comp[other] != comp[i]]
        if len(other):
            yield np.full(len(other), i), other


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links, kept tells whether it is the
    document's own. Defined results: a null or empty text and a text of white space have an empty
    set and no links; a null doc_id links with nothing and stays (component_id null, kept true);
    rows that repeat a doc_id are one document, linked by any of its texts. Columns other than
    doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-dup")
    rows = scratch.table("sketches", sketches(docs))
    sets = ["n_shingles", "f1", "f2"]
    filled = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.table("classes", filled.groupBy(*sets).agg(F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch")))

    start = [F.struct(F.lit(k).alias("band"), F.substring("sketch", 2 * BAND * k + 1, 2 * BAND).alias("key")) for k in range(_BANDS)]
    bands = classes.select("doc_id", F.inline(F.array(*start))).where(F.col("key") != F.lit(bytes(2 * BAND)))
    bands = bands.select("doc_id", "band", F.xxhash64("band", "key").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    bands = scratch.table("bands", bands.join(shared, "bucket"))
    weight = bands.groupBy("doc_id").agg(F.sum("members").alias("weight"))
    hubs = bands.join(weight, "doc_id").groupBy("bucket").agg(F.max(F.struct("weight", "doc_id")).alias("hub"))
    stars = bands.join(hubs.select("bucket", F.col("hub.doc_id").alias("hub")), "bucket").where("doc_id <> hub")
    stars = stars.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()

    texts = packed_texts(docs).join(bands.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = scratch.table("texts", texts)
    tried = scratch.table("stars", _likely(stars, classes))
    links = scratch.table("links", confirmed(tried, texts))
    first = scratch.table("first", components(links, scratch, "one"))

    own = F.coalesce("component_id", "doc_id").alias("component_id")
    placed = bands.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("bucket", "band", "members", "doc_id", own)
    torn = placed.groupBy("bucket").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x <> y").select("bucket")
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("doc_id"), tiles).cast("int")
    placed = placed.join(torn, "bucket").withColumns({"tiles": tiles, "tile": tile})
    # the pair (i, j) of tiles, i <= j; a tile alone is searched within
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    placed = placed.withColumn("other", other).select(
        F.xxhash64("bucket", F.least("tile", "other"), F.greatest("tile", "other")).alias("bucket"),
        F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2).alias("side"),
        "band", "doc_id", "component_id",
    )
    members = placed.join(classes.select("doc_id", "n_shingles", "sketch"), "doc_id")
    members = members.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    members = _across(members.select("bucket", "side", "band", "doc_id", "component_id", "n_shingles", "sketch"))
    members = scratch.table("members", members).join(texts, "doc_id")
    more = _linked(members.repartition("bucket").sortWithinPartitions("bucket", "doc_id"))
    links = scratch.table("all", links.union(more))
    final = scratch.table("final", components(links, scratch, "two"))
    scratch.drop("texts", "bands", "stars", "links", "first", "members", "all")

    roots = classes.select(*sets, F.col("doc_id").alias("root")).join(final, F.col("root") == F.col("id"), "left")
    roots = roots.select(*sets, F.coalesce("component_id", "root").alias("class_root"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_root", "doc_id"))
    out = rows.join(roots, sets, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return _per_document(out)


def _per_document(out: DataFrame) -> DataFrame:
    """Rows with their component; those that repeat a doc_id agree on the smallest one found for it."""
    least = out.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("rows")).where("rows > 1 AND doc_id IS NOT NULL")
    out = out.join(least.select("doc_id", "least"), "doc_id", "left")
    component = F.coalesce("least", "component_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all columns of ``docs``: one row of each component.

    That is the row of the smallest doc_id, null last; rows that share it go by a hash of their text,
    and of equal rows any one stays. Every row is judged by its own text, so a doc_id that holds two
    texts may lose one of them. Defined results: null and empty texts and texts of white space all
    stay; an empty table gives no rows. Columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    given = [F.col(f"_row.`{c}`") for c in docs.columns]
    rows = docs.select(row).select("_row", F.col("_row.doc_id").cast("long").alias("id"), F.col("_row.text").cast("string").alias("words"))
    if not rows.groupBy("id").count().where("id IS NULL OR count > 1").limit(1).count():
        gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone"))
        return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select(*given)
    # doc_ids don't name texts here: a hash does, the first that tells all texts apart
    for seed in itertools.count():
        own, other = F.xxhash64(F.lit(seed), "words"), F.xxhash64(F.lit(-1 - seed), "words")
        ids = scratch.table(f"ids-{seed}", rows.select("id", own.alias("key"), other.alias("other")))
        if not ids.groupBy("key").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y").limit(1).count():
            break
    rows = rows.withColumn("key", own)
    found = near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("words").alias("text")))
    found = scratch.table("found", found.select(F.col("doc_id").alias("key"), "n_shingles", "component_id").distinct())
    best = ids.join(found.where("n_shingles > 0"), "key").groupBy("component_id").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "key")).alias("best"))
    best = best.select(F.col("best.id").alias("best_id"), F.col("best.key").alias("best_key"))
    stay = rows.join(best, (F.col("key") == F.col("best_key")) & F.col("id").eqNullSafe(F.col("best_id")), "left_semi")
    stay = stay.groupBy("id", "key").agg(F.first("_row").alias("_row"))
    empty = rows.join(found.where("n_shingles = 0").select(F.col("key").alias("of")), F.col("key") == F.col("of"), "left_semi")
    return stay.select("_row").union(empty.select("_row")).select(*given)
