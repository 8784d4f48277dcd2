"""Near duplicates of vectors: PCA-ordered tiled comparison with suffix-norm bounds.

Unit vectors are rotated onto the principal axes of a bounded sample (a rotation changes no
cosine), so leading coordinates carry most of a product. Rows are cut into tiles along the first
axis; two tiles meet only if their ranges are near enough for the threshold. Inside a pair of
tiles, products grow by a few leading dimensions at a time, and a pair is dropped as soon as its
partial product plus the product of the two suffix norms cannot reach the threshold. What is left
is checked in double precision on the given components.

A pair of tiles returns one row per linked vector: how many vectors it links with there, and the
smallest vector of its cluster there. Pairs never leave a task, and equal vectors are compared once.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from crawlspark.llm.components import components
from crawlspark.llm.scratch import Scratch
from crawlspark.llm.vectors import lengths, matrix, sample, unit, usable, width as width_of

THRESHOLD = 0.95
TILE = 4096
_STEPS = (16, 32)  # leading dimensions after which pairs are bounded
_SLACK = 1e-4  # for sums in single precision
_CHUNK = 512


def _links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool):
    """Index arrays (i, j) of the linked rows of two tiles, in chunks; i < j within one tile."""
    ua, ub = unit(a), unit(b)
    ra, rb = (ua @ axes).astype(np.float32), (ub @ axes).astype(np.float32)
    dims = ra.shape[1]
    steps = [s for s in _STEPS if s < dims]
    ta, tb = ([np.sqrt(np.maximum(0, (r[:, s:] ** 2).sum(1))) for s in steps] for r in (ra, rb))
    low = np.float32(threshold - _SLACK)
    for start in range(0, len(ra), _CHUNK):
        rows = slice(start, start + _CHUNK)
        first = steps[0] if steps else dims
        partial = ra[rows, :first] @ rb[:, :first].T
        bound = partial + np.outer(ta[0][rows], tb[0]) if steps else partial
        if same:
            bound[np.arange(bound.shape[1])[None, :] <= np.arange(start, start + bound.shape[0])[:, None]] = -2
        i, j = np.nonzero(bound >= low)
        p = partial[i, j]
        i += start
        for lo in range(0, len(i), 1 << 16):
            x, y, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)], p[lo : lo + (1 << 16)]
            for k, s in enumerate(steps[1:], 1):
                q = q + np.einsum("ij,ij->i", ra[x, steps[k - 1] : s], rb[y, steps[k - 1] : s])
                keep = q + ta[k][x] * tb[k][y] >= low
                x, y, q = x[keep], y[keep], q[keep]
            exact = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
            yield x[exact], y[exact]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row of each row's cluster: labels sink along the pairs until none moves."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for i, j in pairs:
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            return root


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts other vectors at cosine >= threshold, component_id is the smallest vec_id
    reachable, kept tells whether it is the vector's own; only vectors of one length are compared. Defined results: vectors without a cosine
    (see ``usable``) link with nothing and stay; a null vec_id has a null component and stays; an
    empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "vector-dup")
    rows = scratch.table("rows", usable(vectors).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")}))
    classes = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    classes = scratch.table("classes", classes)
    dims = width_of(classes)
    fitted = sample(classes.select(F.col("id").alias("vec_id"), "embedding"), dims)
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not len(fitted):
        return found.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = np.linalg.eigh(fitted.T @ fitted)[1][:, ::-1].copy()
    total = classes.count()
    ranges = max(1, min(len(fitted) // 16, -(-total // tile)))
    cuts = np.unique(np.quantile(fitted @ axes[:, 0], np.arange(1, ranges) / ranges)) if ranges > 1 else np.empty(0)
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def place(batches):
        for batch in batches:
            at = np.searchsorted(cuts, unit(matrix(batch.column("embedding"), dims)) @ axes[:, 0], "right") if batch.num_rows else np.empty(0, int)
            yield batch.append_column("range", pa.array(at.astype(np.int32)))

    placed = classes.select("id", "n", "embedding").mapInArrow(place, "id long, n long, embedding array<double>, range int")
    placed = scratch.table("placed", placed)
    # a range that holds many vectors is several tiles
    size = placed.groupBy("range").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    near = [(r, s) for r in range(len(edges) - 1) for s in range(len(edges) - 1) if max(edges[max(r, s)] - edges[min(r, s) + 1], 0) <= reach]
    partners = F.map_from_arrays(F.array(*map(F.lit, range(len(edges) - 1))), F.array(*[F.array(*[F.lit(s) for q, s in near if q == r]) for r in range(len(edges) - 1)]))
    own = size.select("range", "tiles", F.explode(F.element_at(partners, F.col("range"))).alias("other"))
    own = own.join(size.select(F.col("range").alias("other"), F.col("tiles").alias("other_tiles")), "other")
    width = 1 << 20
    mine = F.col("range").cast("long") * width + F.pmod(F.xxhash64("id"), F.col("tiles"))
    dealt = placed.join(own, "range").withColumn("tile", mine)
    dealt = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    dealt = dealt.withColumn("partner", F.col("partner") + F.col("other").cast("long") * width)
    dealt = dealt.select(F.least("tile", "partner").alias("one"), F.greatest("tile", "partner").alias("two"), (F.col("tile") <= F.col("partner")).alias("left"), "id", "n", "embedding")

    def compare(group: pa.Table) -> pa.Table:
        same = group.column("one")[0].as_py() == group.column("two")[0].as_py()
        left = group.column("left").combine_chunks()
        a = group.filter(left)
        b = a if same else group.filter(pc.invert(left))
        ids, weights = (np.concatenate([t.column(c).to_numpy() for t in ((a,) if same else (a, b))]) for c in ("id", "n"))
        shift = 0 if same else a.num_rows
        n, pairs = np.zeros(len(ids), np.int64), []
        if a.num_rows and b.num_rows:
            sizes = lengths(a.column("embedding")), lengths(b.column("embedding"))
            for i, j in _links(matrix(a.column("embedding"), dims), matrix(b.column("embedding"), dims), axes, threshold, same):
                alike = sizes[0][i] == sizes[1][j]
                i, j = i[alike], j[alike] + shift
                n += np.bincount(i, weights[j], len(ids)).astype(np.int64) + np.bincount(j, weights[i], len(ids)).astype(np.int64)
                pairs.append((i, j))
        some = n > 0
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, _roots(len(ids), pairs), ids)
        root = root[_roots(len(ids), pairs)]
        return pa.table({"id": ids[some], "links": n[some], "root": root[some]})

    linked = scratch.table("linked", dealt.groupBy("one", "two").applyInArrow(compare, "id long, links long, root long"))
    final = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch, "parts")
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    classes = classes.select("h1", "h2", "id", "n").join(links, "id", "left").join(final, "id", "left")
    classes = classes.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    per = rows.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = found.join(per, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
