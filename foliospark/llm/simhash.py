"""SimHash near-duplicates by generalised pigeonhole.

A 64-bit fingerprint is the bitwise majority of the XXH64 hashes of a text's
word shingles. Fingerprints that differ in at most k bits are linked; a
component's name is its smallest document id.

To find links, bits are grouped into m partitions, correlated bits together,
and partition i gets a threshold t_i >= -1 with sum(t_i) = k - m + 1: if every
partition differed in more than t_i bits, the whole would differ in more than
k. Dynamic programming picks the thresholds, and m, that need the fewest probes
and candidates, estimated on a bounded sample; the sample steers cost only, any
choice finds every link. Each fingerprint probes the values within t_i bits of
its own in each partition with t_i >= 0, and candidates are verified exactly.

Equal fingerprints are one node. A bucket's links leave a task as a spanning
star, so their number stays below the bucket's rows, and buckets over
BUCKET_ROWS are dealt out as pairs of chunks.

simhash_sets has the form for texts that have to be alike by the similarity of
their shingle sets.

Defined cases: null and empty texts have fingerprint zero, which is linked
like any other; fewer words than a shingle make one shingle; a null doc_id
can't name a component, and one without any other id has a null component;
repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import components, few, scratch, star_forest, table, written

SAMPLE = 2048  # fingerprints that the plan is estimated on
BUCKET_ROWS = 4096

_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z only) words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(words: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    from xxhash import xxh64_intdigest as digest

    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    return np.array([digest(x, seed) for x in parts], np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """The bitwise majority of hashes, as an unsigned integer; zero of none."""
    if not len(found):
        return 0
    counts = np.bincount((found.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts > len(found)).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            found = [hashes(words_of(x), shingle) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(np.array([fingerprint(x) for x in found], np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def ball(width: int, t: int) -> int:
    return sum(math.comb(width, j) for j in range(t + 1))


def partitions(sample: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m groups, each grown from a bit by the bits most correlated with it."""
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(float)
    bits -= bits.mean(0)
    norm = np.sqrt((bits**2).sum(0)) + 1e-9
    near = np.abs(bits.T @ bits / np.outer(norm, norm))
    left, groups = set(range(64)), []
    for i in range(m):
        size = len(left) // (m - i)
        group = [min(left)]
        left.discard(group[0])
        while len(group) < size:
            x = max(sorted(left), key=lambda b: near[b, group].sum())
            group.append(x)
            left.discard(x)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The t_i that sum to total at the least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, extra in cost.items():
                if s + t not in after or c + extra < after[s + t][0]:
                    after[s + t] = (c + extra, [*ts, t])
        best = after
    return best[total]


def plan(sample: np.ndarray, n: int, k: int, row_cost: float = 20.0) -> list[tuple[int, int, list[int]]]:
    """(mask, t, bits) of the partitions to probe, for n fingerprints."""
    pairs = sample[:, None] ^ sample[None, :] if len(sample) else np.zeros((1, 1), np.uint64)
    off = ~np.eye(len(pairs), dtype=bool)
    best = None
    for m in range(2, min(k + 2, 12)):
        groups = partitions(sample, m) if len(sample) > 1 else [list(range(64))[i::m] for i in range(m)]
        costs = []
        for g in groups:
            gap = np.bitwise_count(pairs & np.uint64(mask_of(g)))[off]
            cost = {-1: 0.0}
            for t in range(k + 1):
                hit = max(float((gap <= t).mean()) if gap.size else 0.0, ball(len(g), t) / 2 ** len(g))
                cost[t] = row_cost * n * ball(len(g), t) + n * n / 2 * hit
            costs.append(cost)
        found = thresholds(costs, k - m + 1)
        if best is None or found[0] < best[0]:
            best = (*found, groups)
    return [(mask_of(g), t, g) for t, g in zip(best[1], best[2], strict=True) if t >= 0]


def flips(bits: list[int], t: int) -> list[int]:
    """Masks that flip at most t of the bits."""
    from itertools import combinations

    return [mask_of(list(c)) for j in range(t + 1) for c in combinations(bits, j)]


def signatures(nodes: DataFrame, probes: list[tuple[int, int, list[int]]]) -> DataFrame:
    """(part, key, fp, node): each fingerprint under each value that it probes."""
    masks = [(i, m, flips(bits, t)) for i, (m, t, bits) in enumerate(probes)]

    def run(batches):
        for b in batches:
            fp, node = np.asarray(b.column("fp")).view(np.uint64), np.asarray(b.column("node"))
            for i, mask, flip in masks:
                for f in flip:
                    key = ((fp ^ np.uint64(f)) & np.uint64(mask)).view(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(fp), i, np.int32)), pa.array(key), pa.array(fp.view(np.int64)), pa.array(node)], ["part", "key", "fp", "node"])

    return nodes.select("fp", "node").mapInArrow(run, "part int, key long, fp long, node long")


def dealt(rows: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """Add i and j (ints) so that groups of (*keys, i, j) are of bounded size and any two rows with equal keys meet in one.

    Without a group over `most` rows, rows stay as they are. Groups of up to `most` rows get (0, 0); larger ones are cut into c chunks
    by a hash, and each row goes to the c chunk pairs that hold its chunk.
    """
    large, _ = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most), "large")
    if large.isEmpty():
        return rows
    cut = rows.join(few(large), keys, "left").withColumn("c", F.ceil(F.coalesce("n", F.lit(1)) / most).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(by), F.col("c")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return cut.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("n", "c", "own", "other")


def links_in_runs(batches, keys: list[str], k: int):
    """Arrow batches sorted by keys -> spanning stars (a, b) of the links between rows of equal keys."""

    def links(fp, node, run):
        a, b, held = [], [], 0
        s, at = 1, np.arange(len(fp) - 1) if len(fp) > 1 else np.zeros(0, np.int64)
        at = at[run[at] == run[at + 1]] if len(at) else at
        while len(at):
            near = at[np.bitwise_count(fp[at] ^ fp[at + s]) <= k]
            if len(near):
                a.append(node[near])
                b.append(node[near + s])
                held += len(near)
                if held > 500_000:
                    x, y = star_forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], len(x)
            s += 1
            at = at[at + s < len(fp)]
            at = at[run[at] == run[at + s]]
        if a:
            x, y = star_forest(np.concatenate(a), np.concatenate(b))
            return pa.record_batch([pa.array(x), pa.array(y)], ["a", "b"])
        return None

    rest = None
    for b in batches:
        got = [np.asarray(b.column(x)) for x in (*keys, "fp", "node")]
        rest = got if rest is None else [np.concatenate(x) for x in zip(rest, got, strict=True)]
        if not len(rest[0]):
            continue
        new = np.zeros(len(rest[0]), bool)
        for x in rest[: len(keys)]:
            new[1:] |= x[1:] != x[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0  # the last run may go on
        if last:
            out = links(rest[-2][:last].view(np.uint64), rest[-1][:last], new[:last].cumsum())
            if out is not None:
                yield out
            rest = [x[last:] for x in rest]
    if rest is not None and len(rest[0]):
        out = links(rest[-2].view(np.uint64), rest[-1], np.zeros(len(rest[0]), np.int64))
        if out is not None:
            yield out


def fingerprint_links(nodes: DataFrame, k: int) -> DataFrame:
    """Spanning links (a, b) of the node ids whose fingerprints differ in at most k bits. nodes: written (fp, node); fp unique."""
    n = nodes.count()
    sample = np.array([x["fp"] for x in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    rows = dealt(signatures(nodes, plan(sample, n, k)), ["part", "key"], "fp", BUCKET_ROWS)
    keys = [c for c in ("part", "key", "i", "j") if c in rows.columns]
    spread = rows.repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(lambda batches: links_in_runs(batches, keys, k), "a long, b long")


def near_duplicates(fps: DataFrame, k: int = 3) -> DataFrame:
    """fps (a written table of doc_id, fp) with component_id."""
    with scratch(fps.sparkSession):
        nodes, _ = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "nodes")
        parts = components(fingerprint_links(nodes, k))
        of, _ = written(nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "of", keep=True)
    return fps.join(few(of), "fp", "left")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, _ = written(fingerprints(table(spark, sf_dir, "documents"), shingle=3), "fps")
    return near_duplicates(fps, k=3).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
