"""Product quantisation by ball k-means on integer vectors: exact codes, codebooks and errors.

Every component x becomes floor(scale * x), vectors are cut into equal parts, and each part position
has a codebook of its own. A round assigns every part to its nearest entry and moves each entry to
the floored mean of its parts. What a round knows from the one before, a part's entry, makes a ball
around that entry's new place, its radius the farthest of its parts. Another entry can only win, or tie, if it
lies within twice a part's own distance: so parts nearer than half the way to the next entry form
the stable core and are not compared at all, the ball's radius says which entries are neighbours,
and rings around the entry say how many of them, nearest first, a part is compared with.
All comparisons are of whole numbers, so no rounding decides.

A round is one pass over the rows without a shuffle. Tasks return one sum per entry and component,
which Spark adds up; the driver holds the codebooks: parts x entries x width numbers, whatever the
number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crawlspark.llm.scratch import Scratch

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Whole components end here, and errors at the largest long.
LIMIT = 1 << 62
LARGEST = (1 << 63) - 1
#: Below this, sums of products of doubles are exact.
_EXACT = 1 << 53
_STATE = "kind int, vec_id long, label string, x binary, entries binary, error decimal(38,0), part int, entry int, n long, sums array<decimal(38,0)>"


def _kept(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """Vectors of an Arrow list column as rows of floor(scale * x), filled with zeros up to ``width``."""
    out = np.zeros((len(column), width))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -float(LIMIT), float(LIMIT)).astype(np.int64)


def _numbers(x: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles if all distances between them are exact so, else as Python's whole numbers."""
    peak = max(1, *(max(abs(int(a.min())), abs(int(a.max()))) for a in (x, *others) if a.size), 1)
    exact = 8 * max(1, x.shape[1]) * peak * peak < _EXACT
    return [a.astype(float if exact else object) for a in (x, *others)]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    if x.dtype == object:
        return ((x[:, None, :] - c[None]) ** 2).sum(2) if x.shape[1] else np.zeros((len(x), len(c)), object)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def nearest_entries(x: np.ndarray, codebook: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index of every row's nearest entry, the smallest at ties, and the squared distance.

    ``own`` names any entry for each row, best the nearest one before the codebook moved; without
    it all entries are compared.
    """
    x, c = _numbers(x, codebook)
    best_at, best = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    if own is None:
        for at in range(0, len(x), 4096):
            d = _distances(x[at : at + 4096], c)
            best_at[at : at + 4096] = d.argmin(1)
            best[at : at + 4096] = d.min(1)
        return best_at, best
    between = _distances(c, c)
    ranked = np.argsort(between, axis=1, kind="stable")
    away = np.take_along_axis(between, ranked, 1)
    own_distance = ((x - c[own]) ** 2).sum(1)
    best_at[:], best[:] = own, own_distance
    reach = 4 * own_distance
    loose = np.flatnonzero(reach >= away[own, 1]) if len(c) > 1 else np.zeros(0, np.int64)
    loose = loose[np.lexsort((own_distance[loose], own[loose]))]
    starts = np.flatnonzero(np.diff(own[loose], prepend=-1))
    for members in np.split(loose, starts[1:]):
        if not len(members):
            continue
        i = own[members[0]]
        rings = np.searchsorted(away[i], reach[members], "right")  # the ball's radius is its last member's distance
        cuts = np.flatnonzero(np.diff(np.ceil(np.log2(rings)).astype(int))) + 1
        for ring in np.split(np.arange(len(members)), cuts):
            near = np.sort(ranked[i, : rings[ring[-1]]])
            rows = members[ring]
            d = _distances(x[rows], c[near])
            best_at[rows] = near[d.argmin(1)]
            best[rows] = d.min(1)
    return best_at, best


def _assign(x: np.ndarray, codebooks: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, list[int]]:
    """Entries of all parts (rows x parts) and the summed squared distance of every row."""
    parts, _, part_width = codebooks.shape
    found = [nearest_entries(x[:, p * part_width : (p + 1) * part_width], codebooks[p], None if own is None else own[:, p]) for p in range(parts)]
    return np.stack([at for at, _ in found], 1), [min(int(e), LARGEST) for e in sum(d.astype(object) for _, d in found)]


def _round_of(codebooks: np.ndarray, first: bool, sums: bool, scale: int):
    """One pass: rows with their entries, and the sums of the entries' parts."""
    parts, entries, part_width = codebooks.shape
    names, kinds = zip(*((f.split()[0], f.split()[1]) for f in _STATE.replace("array<decimal(38,0)>", "sums").split(", ")), strict=True)
    decimal = pa.decimal128(38, 0)
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "decimal(38,0)": decimal, "sums": pa.list_(decimal)}

    def batch_of(rows: int, **given) -> pa.RecordBatch:
        arrays = [given[k].cast(types[t]) if isinstance(given.get(k), pa.Array) else pa.array(given[k], types[t]) if k in given else pa.nulls(rows, types[t]) for k, t in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, part_width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if first:
                x, own = whole(batch.column(2), parts * part_width, scale), None
                packed = [row.tobytes() for row in x]
            else:
                packed = batch.column(2).to_pylist()
                x = np.frombuffer(b"".join(packed), np.int64).reshape(n, -1)
                own = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(n, -1).astype(np.int64)
            at, error = _assign(x, codebooks, own)
            if sums:
                small = np.abs(x).max(initial=0) < 1 << 40
                for p in range(parts):
                    mine, part = at[:, p], x[:, p * part_width : (p + 1) * part_width]
                    step = np.zeros((entries, part_width), np.int64 if small else object)
                    np.add.at(step, mine, part if small else part.astype(object))
                    total[p] += step.astype(object)
                    count[p] += np.bincount(mine, minlength=entries)
            yield batch_of(n, kind=[0] * n, vec_id=batch.column(0), label=batch.column(1), x=packed, entries=[r.tobytes() for r in at.astype("<u2")], error=error)
        used = np.argwhere(count)
        if sums and len(used):
            p, e = used.T
            yield batch_of(len(p), kind=[1] * len(p), part=p.tolist(), entry=e.tolist(), n=count[p, e].tolist(), sums=[[int(v) for v in total[i, j]] for i, j in used])

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of every vector kept, and the codebooks (parts, entries, width).

    Left out are null vectors and those with null or non-finite components. Defined results for the
    rest: shorter vectors, and lengths that ``parts`` does not divide, count as filled with zeros up to the table's
    longest; an empty vector is all zeros; null vec_ids come last when the codebooks begin, equal ones
    by their vectors; rows that repeat stay rows of their own; with fewer rows than ``entries`` the
    codebook has as many entries as rows; an empty table gives no rows and empty codebooks. Components
    beyond 2^62 after scaling end there, as do errors at the largest long. Labels are compared as text, nulls
    together. Only vec_id, embedding and label are read. Codes are two hex digits a part (four beyond 256 entries).
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(_kept(F.col("embedding")))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    part_width = -(-longest // parts)
    begin = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow().column(0).combine_chunks()
    books = whole(begin, parts * part_width, scale).reshape(len(begin), parts, part_width).transpose(1, 0, 2).copy()
    now = rows
    for k in range(rounds):
        got = now.mapInArrow(_round_of(books, k == 0, True, scale), _STATE)
        got.write.partitionBy("kind").parquet(scratch.path(f"round-{k}"))
        back = scratch.spark.read.schema(_STATE).parquet(scratch.path(f"round-{k}"))
        per = back.where("kind = 1").select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        for p, e, at, s, n in per.collect():  # at most parts * entries * width rows
            books[p, e, at] = int(s) // n
        now = back.where("kind = 0").select("vec_id", "label", "x", "entries")
        if k:
            scratch.drop(f"round-{k - 1}")
    last = scratch.table("assigned", now.mapInArrow(_round_of(books, rounds == 0, False, scale), _STATE).select("vec_id", "label", "entries", "error"))
    digits = 2 if entries <= 256 else 4
    # entries are little-endian pairs of bytes
    one = lambda p: F.lower(F.concat(*[F.hex(F.substring("entries", 2 * p + b, 1)) for b in ((2, 1) if digits == 4 else (1,))]))
    last = last.withColumn("code", F.concat(*[one(p) for p in range(parts)]))
    per = last.groupBy(F.col("label").alias("of")).agg(F.least(F.sum("error"), F.lit(LARGEST)).cast("long").alias("label_error"))
    out = last.join(per, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "label", "code", F.col("error").cast("long").alias("error"), "label_error"), books


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
