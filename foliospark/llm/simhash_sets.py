"""SimHash near-duplicates by the exact similarity of shingle sets.

A text is the set of the XXH64 hashes of its word shingles. Texts of equal sets
are one node; nodes are linked if the Jaccard similarity of their sets is at
least a bound, and a component's texts are near-duplicates.

One 64-bit fingerprint is too coarse for a bound like 0.8: such a pair differs
in about 15 % of all bits, too many for thresholds over 64 bits. So a set gets
BITS random signs: hashes are summed into DIM signed counters, and a Hadamard
transform turns the counters into projections, whose signs are the bits. The
generalised pigeonhole is the same: bits are grouped into partitions of
correlated bits, and dynamic programming gives each partition its own threshold
at the least estimated candidate count. What the thresholds have to reach is
not a sum but a chance: a pair at the bound, whose bits differ with a known
probability, is missed by all partitions with at most MISS, and pairs above it
less often. Width and thresholds are planned from the number of nodes and a
bounded sample, which steer cost only.

Nodes under one value of a partition whose FILTER further bits are near are
candidates, and only those are compared, on their whole sets, which are made
again for them: no link is estimated. Candidates travel as members of groups,
not as pairs; groups of the same members are compared once, and groups over
RUN_ROWS are dealt out as pairs of chunks.

Defined cases: null and empty texts have the empty set, which equals itself
only; fewer words than a shingle make one shingle; sets are told apart by 64
bits; other columns, null ids among them, are passed on; an empty table gives
no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .shared import components, few, scratch, star_forest, written
from .simhash import BUCKET_ROWS, SAMPLE, dealt, hashes, words_of

SIDE = 64  # the Hadamard transform of SIDE * SIDE counters is one of SIDE on either side
DIM = SIDE * SIDE
BITS, FILTER = 2048, 128
WORDS = [f"f{i}" for i in range(FILTER // 64)]
MISS = 0.001
FAR = 4.5  # deviations of the filter; beyond it lies less than one pair in a hundred thousand
WIDTHS = (8, 10, 12, 14, 16, 18, 20, 22, 24)
PLAN = 256  # fingerprints of the sample whose pairs are counted
RUN_ROWS = 1024
BINS = 256

_H = np.ones((1, 1), np.float32)
while len(_H) < SIDE:
    _H = np.block([[_H, _H], [_H, -_H]])


def long_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """BITS + FILTER random signs of each set of hashes, as rows of packed bytes."""
    out = []
    for lo in range(0, len(sets), SIDE):
        part = sets[lo : lo + SIDE]
        found = np.concatenate([np.zeros(0, np.uint64), *part])
        owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
        signs = 1.0 - 2.0 * (found >> np.uint64(40) & np.uint64(1)).astype(np.float64)
        sums = np.bincount(owner * DIM + (found % np.uint64(DIM)).astype(np.int64), signs, len(part) * DIM)
        turned = _H[: (BITS + FILTER) // SIDE] @ sums.astype(np.float32).reshape(-1, SIDE, SIDE) @ _H
        out.append(np.packbits(turned.reshape(len(part), -1) > 0, axis=1, bitorder="little"))
    return np.concatenate(out) if out else np.zeros((0, (BITS + FILTER) // 8), np.uint8)


def differing(similarity: float) -> float:
    """The probability that a bit of two sets at this similarity differs, with a margin for counters that hashes share."""
    return math.acos(max(0.0, 2 * similarity / (1 + similarity) - 1 / math.sqrt(DIM))) / math.pi


def within(width: int, t: int, p: float) -> float:
    return sum(math.comb(width, j) * p**j * (1 - p) ** (width - j) for j in range(t + 1))


def correlated(bits: np.ndarray, width: int) -> list[np.ndarray]:
    """Positions of all bits in groups of `width`, each grown from a bit by those most correlated with it. bits: (n, positions) of 0 and 1."""
    x = bits - bits.mean(0) if len(bits) else np.zeros((1, bits.shape[1]))
    x = x / (np.sqrt((x * x).sum(0)) + 1e-9)
    near = np.abs(x.T @ x)
    free, groups = np.ones(bits.shape[1], bool), []
    for _ in range(bits.shape[1] // width):
        group = [int(free.argmax())]
        free[group[0]] = False
        score = near[group[0]].copy()
        while len(group) < width:
            group.append(int(np.where(free, score, -1.0).argmax()))
            free[group[-1]] = False
            score += near[group[-1]]
        groups.append(np.array(sorted(group)))
    return groups


def allocate(costs: list[dict[int, float]], gains: dict[int, float], goal: float) -> tuple[float, list[int]] | None:
    """A threshold for each partition, -1 to skip it, whose gains reach the goal at the least cost, by dynamic programming."""
    unit = goal / 400
    gain = {t: int(g / unit) for t, g in gains.items()}  # rounded down, so the goal is met
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for have, (c, ts) in best.items():
            for t, extra in cost.items():
                at = min(400, have + gain[t])
                if at not in after or c + extra < after[at][0]:
                    after[at] = (c + extra, [*ts, t])
        best = after
    return best.get(400)


def plan(sample: np.ndarray, n: int, similarity: float, row_cost: float = 100.0) -> list[tuple[np.ndarray, int]]:
    """(positions, t) of the partitions to probe, for n nodes. sample: (some, BITS) of 0 and 1."""
    p, best = differing(similarity), None
    for width in WIDTHS:
        groups = correlated(sample.astype(np.float32), width)
        gains = {-1: 0.0} | {t: -math.log1p(-within(width, 2 * t, p)) for t in (0, 1)}
        costs = []
        for g in groups:
            codes = sample[:PLAN, g].astype(np.int64) @ (1 << np.arange(width))
            gap = np.bitwise_count(codes[:, None] ^ codes[None, :])
            cost = {-1: 0.0}
            for t in (0, 1):
                met = ((gap <= 2 * t).sum() - len(codes)) / max(1, len(codes) * (len(codes) - 1))
                cost[t] = row_cost * n * (1 + width * t) + n * n / 2 * max(met, within(width, 2 * t, 0.5))
            costs.append(cost)
        found = allocate(costs, gains, -math.log(MISS))
        if found is not None and (best is None or found[0] < best[0]):
            best = (*found, groups)
    return [(g, t) for g, t in zip(best[2], best[1], strict=True) if t >= 0]


def hashed(docs: DataFrame, shingle: int, text_col: str = "text") -> DataFrame:
    """docs, written, with _uid (a row's own number), _node (its set) and _bits (its long fingerprint)."""
    from xxhash import xxh64_intdigest as digest

    rows = docs.withColumn("_uid", F.monotonically_increasing_id())
    at = rows.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts, node, bits = b.column(at), [], []
            for lo in range(0, len(texts), 512):
                sets = [np.unique(hashes(words_of(x), shingle)) for x in texts.slice(lo, 512).to_pylist()]
                node += [digest(x.tobytes()) for x in sets]
                bits += [x.tobytes() for x in long_fingerprints(sets)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(bits, pa.binary())], [*b.schema.names, "_node", "_bits"])

    schema = StructType([*rows.schema.fields, StructField("_node", LongType()), StructField("_bits", BinaryType())])
    return written(rows.mapInArrow(run, schema), "hashed", keep=True)[0]


def signatures(nodes: DataFrame, probes: list[tuple[np.ndarray, int]]) -> DataFrame:
    """(key, node, the filter's words): each node under each value that it probes."""

    def run(batches):
        for b in batches:
            packed = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            bits = np.unpackbits(packed[:, : BITS // 8], axis=1, bitorder="little")
            words = np.ascontiguousarray(packed[:, BITS // 8 :]).view(np.int64)
            for i, (at, t) in enumerate(probes):
                code = bits[:, at].astype(np.int64) @ (1 << np.arange(len(at))) | i << 32
                for flip in [0, *(1 << np.arange(len(at))).tolist()][: 1 + len(at) * t]:
                    yield pa.record_batch([pa.array(code ^ flip), b.column("node"), *(pa.array(words[:, k]) for k in range(len(WORDS)))], ["key", "node", *WORDS])

    return nodes.select("node", "bits").mapInArrow(run, "key long, node long, " + ", ".join(f"{x} long" for x in WORDS))


def candidate_groups(batches, keys: list[str], most: int):
    """Arrow batches of signatures, sorted by keys -> (key, node) of groups of nodes that near filters connect within equal keys."""

    def groups(cols, run):
        node, words = cols[len(keys)], np.stack([x.view(np.uint64) for x in cols[len(keys) + 1 :]], 1)
        a, b, held, s = [], [], 0, 1
        at = np.flatnonzero(run[1:] == run[:-1])
        while len(at):
            near = at[np.bitwise_count(words[at] ^ words[at + s]).sum(1, dtype=np.int64) <= most]
            if len(near):
                a.append(near)
                b.append(near + s)
                held += len(near)
                if held > 500_000:
                    x, y = star_forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], len(x)
            s += 1
            at = at[at + s < len(node)]
            at = at[run[at] == run[at + s]]
        if not a:
            return None
        x, root = star_forest(np.concatenate(a), np.concatenate(b))
        member, root = np.concatenate([x, np.unique(root)]), np.concatenate([root, np.unique(root)])
        # a group's name: its partition's value and its first member
        name = (cols[0][root].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ node[root].view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
        return pa.record_batch([pa.array(name), pa.array(node[member])], ["key", "node"])

    rest = None
    for b in batches:
        got = [np.asarray(b.column(x)) for x in (*keys, "node", *WORDS)]
        rest = got if rest is None else [np.concatenate(x) for x in zip(rest, got, strict=True)]
        new = np.zeros(len(rest[0]), bool)
        for x in rest[: len(keys)]:
            new[1:] |= x[1:] != x[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0  # the last run may go on
        if last:
            if (out := groups([x[:last] for x in rest], new[:last].cumsum())) is not None:
                yield out
            rest = [x[last:] for x in rest]
    if rest is not None and len(rest[0]) and (out := groups(rest, np.zeros(len(rest[0]), np.int64))) is not None:
        yield out


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, node): groups of nodes that may be similar, each set of members once. nodes: written (node, bits)."""
    n = nodes.count()
    packed = [bytes(x["bits"]) for x in nodes.select("bits").orderBy(F.xxhash64("bits")).limit(SAMPLE).collect()]
    sample = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(-1, (BITS + FILTER) // 8)[:, : BITS // 8], axis=1, bitorder="little")
    p = differing(similarity)
    most = math.ceil(FILTER * p + FAR * math.sqrt(FILTER * p * (1 - p)))
    rows = dealt(signatures(nodes, plan(sample, n, similarity)), ["key"], "node", BUCKET_ROWS)
    keys = [c for c in ("key", "i", "j") if c in rows.columns]
    spread = rows.repartition(*keys).sortWithinPartitions(*keys)
    found, _ = written(spread.mapInArrow(lambda batches: candidate_groups(batches, keys, most), "key long, node long").distinct(), "groups")
    same = found.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"))
    chosen, _ = written(same.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "chosen")
    return found.join(few(chosen), "key", "left_semi")


def star(node: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Spanning links of nodes whose sets are similar enough; pairs that are joined already aren't compared again."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    node, sets = node[order], [sets[k] for k in order]
    size = np.array([len(x) for x in sets])
    counts = np.array([np.bincount((x & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS) for x in sets])
    counts = counts.astype(np.uint16 if counts.max() < 1 << 16 else np.int64)
    root, a, b = np.arange(len(sets)), [], []
    for s in range(1, len(sets)):
        low, high = size[:-s], size[s:]
        near = np.flatnonzero(low >= similarity * high - 1e-6)
        if not len(near):
            break  # sizes ascend, so partners further on are larger still
        near = near[root[near] != root[near + s]]
        # an intersection is at most the sum of the lesser counts by bin, so this drops no link
        most = np.concatenate([np.minimum(counts[x], counts[x + s]).sum(1, dtype=np.int64) for x in np.array_split(near, 1 + len(near) // 4096)])
        near = near[most >= similarity * (low[near] + high[near] - most) - 1e-6]
        for p in near.tolist():
            q = p + s
            if root[p] == root[q]:
                continue
            both = np.sort(np.concatenate([sets[p], sets[q]]))
            common = int((both[1:] == both[:-1]).sum())
            if common / (len(both) - common) >= similarity:
                root[root == root[q]] = root[p]
                a.append(int(node[p]))
                b.append(int(node[q]))
    return a, b


def compared(batches, keys: list[str], similarity: float):
    """Arrow batches (*keys, node, shingles), sorted by keys -> spanning links (a, b) of each run of equal keys."""

    def links(node, sets):
        a, b = star(np.array(node, np.int64), sets, similarity) if len(sets) > 1 else ([], [])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    last, node, sets = None, [], []
    for batch in batches:
        for *key, x, found in zip(*(batch.column(c).to_pylist() for c in (*keys, "node", "shingles")), strict=True):
            if key != last:
                if len(sets) > 1:
                    yield links(node, sets)
                last, node, sets = key, [], []
            node.append(x)
            sets.append(np.frombuffer(found, np.uint64))
    yield links(node, sets)


def set_links(rows: DataFrame, nodes: DataFrame, shingle: int, similarity: float, text_col: str = "text") -> DataFrame:
    """Spanning links (a, b) of similar nodes. rows: of hashed(); nodes: written (node, _uid of one of its rows, bits)."""
    members, _ = written(candidates(nodes, similarity), "members")
    wanted, _ = written(members.select("node").distinct().join(nodes.select("node", "_uid"), "node").select("_uid"), "wanted")

    def run(batches):
        for b in batches:
            sets = [np.unique(hashes(words_of(x), shingle)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = rows.select("_uid", F.col("_node").alias("node"), F.col(text_col).alias("text")).join(few(wanted), "_uid", "left_semi").select("node", "text")
    sets, _ = written(texts.mapInArrow(run, "node long, shingles binary"), "sets")
    rows = dealt(members, ["key"], "node", RUN_ROWS)
    keys = [c for c in ("key", "i", "j") if c in rows.columns]
    spread = rows.join(sets, "node").select(*keys, "node", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(lambda batches: compared(batches, keys, similarity), "a long, b long")


def first_of_each(docs: DataFrame, shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: the first by id, null ids last, then by a hash of the row."""
    with scratch(docs.sparkSession):
        rows = hashed(docs, shingle, text_col)
        order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("hash"), "_uid")
        nodes, _ = written(rows.groupBy(F.col("_node").alias("node")).agg(F.min(order).alias("first"), F.first("_bits").alias("bits")).withColumn("_uid", F.col("first._uid")), "nodes")
        parts = components(set_links(rows, nodes, shingle, similarity, text_col))
        of = nodes.select("node", "first").join(parts, "node", "left")
        firsts = of.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first")).select(F.col("first._uid").alias("_uid"))
        gone, _ = written(rows.select("_uid").join(firsts, "_uid", "left_anti"), "gone", keep=True)
    return rows.join(few(gone), "_uid", "left_anti").select(*docs.columns)
