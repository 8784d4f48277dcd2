"""Approximate nearest neighbours by stable projections, a kd-tree, and a chi-square stopping test.

Unit vectors are projected to ``DIMENSIONS`` normal (2-stable) directions. The squared projected
distance of two vectors, over their true one, is chi-square distributed with that many degrees. A
query takes projected neighbours in order of distance and verifies each with the true cosine; it
stops when a vector as near as its k-th best would have been projected nearer than the next
neighbour with probability ``CONFIDENCE``.

The upper levels of the tree are fitted on a bounded sample and deal every row to a cell; cells of
many rows are split by hash. A task builds the lower levels over one cell and answers a block of
queries, so a task holds ``BLOCK`` rows and ``QUERIES`` queries whatever the input. Leaves are taken
in the order of their boxes' distance, which is the tree's incremental search.
"""

from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from crawlspark.llm.scratch import Scratch
from crawlspark.llm.vectors import lengths, matrix, sample, unit, usable, width

DIMENSIONS = 12
CONFIDENCE = 0.99
BLOCK = 8192
QUERIES = 1024
LEAF = 64
_LEAVES = 8  # verified between two stopping tests
SEED = 10


def chi_square_quantile(p: float, degrees: int) -> float:
    """Wilson and Hilferty's cube-root approximation."""
    a = 2 / (9 * degrees)
    return degrees * max(0.0, 1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def split(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: halves along the widest side until a leaf is small."""
    waiting, leaves = [np.arange(len(points))], []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        side = np.ptp(points[rows], axis=0).argmax()
        order = rows[np.argpartition(points[rows, side], len(rows) // 2)]
        waiting += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return leaves


def fit_cells(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Upper tree as a heap of (side, cut), at most the next power of two of cells."""
    depth = max(0, (cells - 1).bit_length())
    heap: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for part in level:
            side = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
            cut = float(np.median(part[:, side])) if len(part) else 0.0
            heap.append((side, cut))
            below += [part[part[:, side] < cut], part[part[:, side] >= cut]]
        level = below
    return heap


def cell_of(points: np.ndarray, heap: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    sides, cuts = (np.array(x) for x in zip(*heap, strict=True)) if heap else (np.empty(0, int), np.empty(0))
    for _ in range((len(heap) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), sides[at]] >= cuts[at])
    return at - len(heap)


#: Projections of equal vectors differ by less than this, squared.
_ROUNDING = 1e-9


def search(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, projection: np.ndarray, k: int, confidence: float, sizes: tuple[np.ndarray, np.ndarray]):
    """(query row, vec_id, cosine) of the k best rows found for each query, its own id aside.

    ``sizes`` are the lengths of the queries' and the rows' vectors; only equal ones are compared.
    """
    uq, ur = unit(queries), unit(rows)
    pq, pr = uq @ projection, ur @ projection
    leaves = split(pr, LEAF)
    low, high = (np.stack([f(pr[x], axis=0) for x in leaves]) for f in (np.min, np.max))
    stop = chi_square_quantile(confidence, projection.shape[1])
    for n in range(len(uq)):
        gap = np.maximum(0, np.maximum(low - pq[n], pq[n] - high))
        distance = (gap * gap).sum(1)
        order = np.argsort(distance, kind="stable")
        best_id, best = np.empty(0, np.int64), np.empty(0)
        for start in range(0, len(order), _LEAVES):
            # squared distance of unit vectors is 2 - 2 * cosine
            if len(best) >= k and distance[order[start]] > stop * max(0.0, 2 - 2 * best[k - 1]) + _ROUNDING:
                break
            near = np.concatenate([leaves[x] for x in order[start : start + _LEAVES]])
            near = near[(ids[near] != own[n]) & (sizes[1][near] == sizes[0][n])]
            # row by row, so equal vectors have equal scores wherever they stand
            cosine = np.concatenate([best, (ur[near] * uq[n]).sum(1)])
            found = np.concatenate([best_id, ids[near]])
            top = np.lexsort((found, -cosine))[:k]
            best_id, best = found[top], cosine[top]
        yield n, best_id, best


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, block: int = BLOCK) -> DataFrame:
    """The k nearest rows found for every query: query_id, rank, vec_id, score (cosine in double precision).

    Defined results: vectors without a cosine (see ``usable``) take no part, so a query without one
    has no rows; vectors of another length than the query's are no candidates; fewer candidates than k are all returned; ties go to the smaller vec_id; an empty
    table gives no rows. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    rows = scratch.table("rows", usable(vectors))
    dims = width(rows) or 1
    fitted = sample(rows, dims)
    total = rows.count()
    projection = np.random.default_rng(SEED).standard_normal((dims, dimensions))
    heap = fit_cells(fitted @ projection, min(max(1, len(fitted) // 64), -(-total // block))) if len(fitted) else []

    def place(batches):
        for batch in batches:
            at = cell_of(unit(matrix(batch.column("embedding"), dims)) @ projection, heap) if batch.num_rows else np.empty(0, np.int64)
            yield batch.append_column("cell", pa.array(at))

    placed = scratch.table("placed", rows.mapInArrow(place, "vec_id long, embedding array<double>, cell long"))
    size = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    queries = rows.where(is_query).select(F.col("vec_id"), "embedding")
    asked = -(-queries.count() // QUERIES)
    index = placed.join(size, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    index = index.select(F.col("cell"), F.col("part"), F.explode(F.sequence(F.lit(0), F.lit(max(0, asked - 1)))).alias("asked"), F.lit(False).alias("query"), "vec_id", "embedding")
    blocks = size.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # each block of queries visits every block of the index, through an equi-join on a list of the blocks
    queries = queries.withColumn("asked", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(max(1, asked))).cast("int"))
    visits = blocks.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(max(0, asked - 1)))))
    queries = visits.join(queries, "asked").select("cell", "part", "asked", F.lit(True).alias("query"), "vec_id", "embedding")

    def answer(group: pa.Table) -> pa.Table:
        flag = group.column("query").combine_chunks()
        q, r = group.filter(flag), group.filter(pc.invert(flag))
        out = {"query_id": [], "vec_id": [], "score": []}
        if q.num_rows and r.num_rows:
            own = q.column("vec_id").to_numpy()
            for n, ids, score in search(matrix(q.column("embedding"), dims), own, matrix(r.column("embedding"), dims), r.column("vec_id").to_numpy(), projection, k, confidence, (lengths(q.column("embedding")), lengths(r.column("embedding")))):
                out["query_id"].append(np.full(len(ids), own[n])), out["vec_id"].append(ids), out["score"].append(score)
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate([np.empty(0, kinds[c]), *v]) for c, v in out.items()})

    found = index.unionByName(queries).groupBy("cell", "part", "asked").applyInArrow(answer, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
