"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length one, so cosine >= c means a squared distance of at
most 2 - 2c. They are rotated onto the principal axes and cut into blocks of
BLOCK axes; block b gets a share of that distance, its budget, in proportion to
the variance it holds. A linked pair stays within the budget in one block at
least, so each block is range-joined by itself:

* a bounded, hash-chosen sample gives pivots; a vector is at home in the cell
  of its nearest pivot, and visits every cell of a lower number whose border,
  the bisecting plane, is within the block's radius;
* a cell's homes meet each other and its visitors, in chunks of bounded size;
* pairs within the budget, by one single-precision product of a chunk's
  coordinates with slack, are candidates. They are taken up in the first block
  that has them, and verified in double precision on the vectors as given.

A task returns each vector's number of links and a spanning star of them, never
its pairs. Equal vectors are one node; their number counts as links.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and are returned; vectors of different lengths
are not compared with each other; every row is compared, so rows of one vec_id
and equal rows link like any others; a row without vec_id links too, but can't
name a component: one without any other id has none; an empty table gives no
rows; other columns are ignored; arrays of doubles keep their precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import components, scratch, star_forest, table, written

BLOCK = 8
CELL = 16384  # vectors aimed at in a cell
PIVOTS = 4096  # at most, so the table of cells is bounded
CHUNK = 16384  # rows of a cell that one task compares with as many others
SLACK = 1e-6  # on squared distances, against rounding
ROUGH = 1e-4  # the same in single precision
#: Products are stacks of ROWS x COLS, which stay in a core's cache and are too small for a linear algebra library to start threads for.
ROWS, COLS, STACK = 16, 1024, 16
FAR = 1e6


@dataclass
class Plan:
    cosine: float
    axes: np.ndarray  # (dim, dim): columns are the principal axes
    blocks: list[tuple[int, int]]
    budgets: np.ndarray  # of squared distance
    pivots: list[np.ndarray]  # by block


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of float components in double precision, of length one; scaled first, so that no square leaves the range."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotated(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Each row alone, by a fixed order of sums, so that every task gets the same digits."""
    return np.einsum("ij,jk->ik", unit(x), axes, optimize=False)


def matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def make_plan(nodes: DataFrame, n: int, dim: int, cosine: float) -> Plan:
    """Axes from the second moments of all vectors, pivots from a sample of at most PIVOTS."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            x = unit(matrix(b.column(0), dim))
            total += x.T @ x
        yield pa.record_batch([pa.array(np.repeat(np.arange(dim), dim)), pa.array(np.tile(np.arange(dim), dim)), pa.array(total.ravel())], ["i", "j", "x"])

    cov = np.zeros((dim, dim))
    for r in nodes.select("vector").mapInArrow(moments, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # dim * dim rows
        cov[r["i"], r["j"]] = r["x"] / n
    variances, axes = np.linalg.eigh((cov + cov.T) / 2)
    # deal the axes out in turn, so that each block holds its part of the strong ones
    k = max(1, round(dim / BLOCK))
    order = np.concatenate([np.arange(dim)[::-1][i::k] for i in range(k)])
    axes, variances = axes[:, order], np.maximum(variances[order], 1e-12)
    ends = np.cumsum([len(range(i, dim, k)) for i in range(k)])
    blocks = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    share = np.array([variances[a:z].sum() for a, z in blocks])
    budgets = (2 - 2 * cosine) * share / share.sum()
    count = int(min(PIVOTS, max(1, -(-n // CELL))))
    rows = nodes.select("vector").orderBy(F.xxhash64("vector")).limit(count).collect()
    sample = rotated(np.array([r["vector"] for r in rows], np.float64).reshape(-1, dim), axes)
    return Plan(cosine, axes, blocks, budgets, [np.unique(sample[:, a:z], axis=0) for a, z in blocks])


def cells(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of every cell that a row of x is at home in or visits."""
    d2 = ((x * x).sum(1)[:, None] - 2 * x @ pivots.T) + (pivots * pivots).sum(1)[None, :]
    home = d2.argmin(1)
    own = np.take_along_axis(d2, home[:, None], 1)
    between = np.sqrt(((pivots[home][:, None, :] - pivots[None, :, :]) ** 2).sum(2)) if len(pivots) <= 64 else np.sqrt(np.maximum(0, (pivots**2).sum(1)[home][:, None] + (pivots**2).sum(1)[None, :] - 2 * pivots[home] @ pivots.T))
    visits = (d2 - own <= 2 * (radius + SLACK) * between + SLACK) & (np.arange(len(pivots))[None, :] < home[:, None])
    row, cell = np.nonzero(visits)
    return np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell]), np.concatenate([np.ones(len(x), bool), np.zeros(len(row), bool)])


def dealt(nodes: DataFrame, plan: Plan, dim: int) -> DataFrame:
    """(block, cell, i, j, left, right, node, copies, vector): the rows that meet, in groups of bounded size."""
    step = 1024

    def each(batches):
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                turned = rotated(matrix(part.column("vector"), dim), plan.axes)
                for k, (a, z) in enumerate(plan.blocks):
                    yield part, k, *cells(turned[:, a:z], plan.pivots[k], float(np.sqrt(plan.budgets[k])))

    def count(batches):
        total: dict[tuple[int, int], list[int]] = {}
        for _, k, _, cell, home in each(batches):
            size = len(plan.pivots[k])
            for which in (0, 1):
                n = np.bincount(cell[home == (which == 0)], minlength=size)
                for c in np.flatnonzero(n).tolist():
                    total.setdefault((k, c), [0, 0])[which] += int(n[c])
        rows = [(k, c, *n) for (k, c), n in total.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(x, pa.int64()) for x in cols], ["block", "cell", "homes", "visitors"])

    # one row for each block and pivot, bounded by PIVOTS
    sizes = nodes.mapInArrow(count, "block long, cell long, homes long, visitors long").groupBy("block", "cell").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors")).collect()
    wide = max(len(p) for p in plan.pivots)
    homes, visitors = np.ones((2, len(plan.blocks), wide), np.int64)
    for r in sizes:
        homes[r["block"], r["cell"]] = max(1, -(-r["homes"] // CHUNK))
        visitors[r["block"], r["cell"]] = -(-r["visitors"] // CHUNK)

    def send(batches):
        for part, k, row, cell, home in each(batches):
            at = np.asarray(part.column("node"))[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            h, v = homes[k, cell], visitors[k, cell]
            own = np.where(home, at % h.astype(np.uint64), at % np.maximum(v, 1).astype(np.uint64)).astype(np.int64)
            # groups: (i, j) of two home chunks i <= j, and (i, h + j) of a home and a visitor chunk
            times = np.where(home, h + v, h)
            which = np.repeat(np.arange(len(row)), times)
            k_th = np.arange(len(which)) - np.repeat(times.cumsum() - times, times)
            c, n, is_home = own[which], h[which], home[which]
            with_home = is_home & (k_th < n)
            i = np.where(with_home, np.minimum(c, k_th), np.where(is_home, c, k_th))
            j = np.where(with_home, np.maximum(c, k_th), np.where(is_home, k_th, n + c))
            left = is_home & (i == c)
            right = np.where(with_home, j == c, ~is_home)
            got = part.take(pa.array(row[which]))
            yield pa.record_batch([pa.array(np.full(len(which), k, np.int32)), pa.array(cell[which].astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(left), pa.array(right), *got.columns], ["block", "cell", "i", "j", "left", "right", *got.schema.names])

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.mapInArrow(send, f"block int, cell int, i int, j int, left boolean, right boolean, node long, copies long, vector {kind}")


def set_bits(near: np.ndarray) -> np.ndarray:
    """Flat places of the true values of a mostly false array whose size is a multiple of eight."""
    words = np.flatnonzero(near.reshape(-1).view(np.uint64))
    i, j = np.nonzero(near.reshape(-1, 8)[words])
    return words[i] * 8 + j


def join_group(block: int, left, right, plan: Plan, same: bool = False):
    """Links of one group: (nodes, number of links of each), and a spanning star (a, b).

    left and right: (node, copies, vectors, rotated), without a node in common
    unless they are the same rows, of which each pair is then taken once.
    """
    (ln, lc, lv, lr), (rn, rc, rv, rr) = left, right
    a, z = plan.blocks[block]
    # one product gives the squared distances: |x|2 * 1 + 1 * |y|2 - 2 x.y
    left32, right32 = lr.astype(np.float32), rr.astype(np.float32)
    x, y = left32[:, a:z], right32[:, a:z]
    n, m = -(-len(x) // ROWS) * ROWS, -(-len(y) // COLS) * COLS
    p, q = np.zeros((n, z - a + 2), np.float32), np.zeros((z - a + 2, m), np.float32)
    p[: len(x), : z - a], q[: z - a, : len(y)] = -2 * x, y.T
    p[:, -1], q[-2] = 1, 1
    p[:, -2], q[-1] = FAR, FAR  # rows to fill up with are far from all
    p[: len(x), -2], q[-1, : len(y)] = (x * x).sum(1), (y * y).sum(1)
    p, q = p.reshape(-1, ROWS, z - a + 2), np.ascontiguousarray(q.reshape(z - a + 2, -1, COLS).transpose(1, 0, 2))
    budget, least = np.float32(plan.budgets[block] + ROUGH), np.float32(plan.cosine - ROUGH)
    by_left, by_right, stars, held = np.zeros(len(ln)), np.zeros(len(rn)), [], 0
    for lo in range(0, len(p), STACK):
        for at in range(lo * ROWS // COLS if same else 0, len(q)):
            near = set_bits(np.matmul(p[lo : lo + STACK], q[at]) <= budget)
            for k in range(0, len(near), 65536):
                i, j = np.divmod(near[k : k + 65536], COLS)
                i, j = i + lo * ROWS, j + at * COLS
                if same:
                    i, j = i[i < j], j[i < j]
                ok = np.einsum("ij,ij->i", left32[i], right32[j]) >= least
                i, j = i[ok], j[ok]
                gaps = (lr[i] - rr[j]) ** 2
                first = np.ones(len(i), bool)
                for b, (s, e) in enumerate(plan.blocks[: block + 1]):
                    within = gaps[:, s:e].sum(1) <= plan.budgets[b] + SLACK
                    first &= within if b == block else ~within
                i, j = i[first], j[first]
                u, v = lv[i].astype(np.float64), rv[j].astype(np.float64)
                cos = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1))
                ok = cos >= plan.cosine
                i, j = i[ok], j[ok]
                if len(i):
                    by_left += np.bincount(i, rc[j], len(ln))
                    by_right += np.bincount(j, lc[i], len(rn))
                    stars.append(star_forest(ln[i], rn[j]))
                    held += len(stars[-1][0])
                    if held > 200_000:
                        stars = [star_forest(*(np.concatenate(t) for t in zip(*stars, strict=True)))]
                        held = len(stars[0][0])
    if not stars:
        return None
    some_left, some_right = by_left > 0, by_right > 0
    nodes, at = np.unique(np.concatenate([ln[some_left], rn[some_right]]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([by_left[some_left], by_right[some_right]])).astype(np.int64)
    return nodes, counts, star_forest(*(np.concatenate(t) for t in zip(*stars, strict=True)))


def linked(nodes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(node, links, root): partial counts of links by node, and edges node - root. nodes: written (node, copies, vector) of finite vectors of one length."""
    n = nodes.count()
    if n < 2:
        return nodes.sparkSession.createDataFrame([], "node long, links long, root long")
    plan = make_plan(nodes, n, dim, cosine)
    keys = ["block", "cell", "i", "j"]
    rows = dealt(nodes, plan, dim).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held, key = [], None

        def close():
            part = pa.Table.from_batches(held).combine_chunks()
            vectors = matrix(part.column("vector").combine_chunks(), dim)
            cols = np.asarray(part.column("node")), np.asarray(part.column("copies")), vectors, rotated(vectors, plan.axes)
            is_left, is_right = np.asarray(part.column("left")), np.asarray(part.column("right"))
            own = [c[is_left] for c in cols]
            if key[2] == key[3]:  # a chunk with itself: each pair once
                got = join_group(key[0], own, own, plan, same=True)
            else:
                got = join_group(key[0], own, [c[is_right] for c in cols], plan)
            if got is None:
                return None
            found, counts, (a, b) = got
            roots = np.full(len(found), -1, np.int64)
            at = np.searchsorted(found, a)
            roots[at] = b
            none = np.ones(len(found), bool)
            none[at] = False
            return pa.record_batch([pa.array(found), pa.array(counts), pa.array(roots, mask=none)], ["node", "links", "root"])

        for b in batches:
            ids = np.stack([np.asarray(b.column(x)) for x in keys], 1) if b.num_rows else np.zeros((0, 4), np.int32)
            cut = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True):
                if hi == lo:
                    continue
                own = tuple(ids[lo].tolist())
                if key is not None and own != key:
                    if (out := close()) is not None:
                        yield out
                    held = []
                key = own
                held.append(b.slice(lo, hi - lo))
        if held and (out := close()) is not None:
            yield out

    return rows.mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    kind = "array<double>" if vectors.schema[vector_col].dataType.simpleString() == "array<double>" else "array<float>"
    vector = F.col(vector_col).cast(kind)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))
    # adding zero makes -0.0 a 0.0, so equal vectors have equal bytes
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, F.transform(vector, lambda x: (x + F.lit(0).cast(kind[6:-1])))).alias("vector"))
    spark = vectors.sparkSession
    alike = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes, _ = written(alike.select(F.monotonically_increasing_id().alias("node"), "copies", "least", "vector"), "nodes")
    with scratch(spark):
        dims = [r["dim"] for r in nodes.select(F.size("vector").alias("dim")).distinct().collect()]  # at most as many as the longest vector has components
        found = None
        for dim in sorted(dims):
            part, _ = written(linked(nodes.where(F.size("vector") == dim).select("node", "copies", "vector"), dim, cosine), "links")
            found = part if found is None else found.union(part)
        if found is None:
            found = spark.createDataFrame([], "node long, links long, root long")
        parts = components(found.where("root IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b")))
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        of = nodes.join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        of, _ = written(of.select("node", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "of", keep=True)
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    told = nodes.select("node", "vector").join(of.join(ids, "component").select("node", "n_links", "component_id"), "node").drop("node")
    out = rows.where("vector IS NOT NULL").join(told, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)
