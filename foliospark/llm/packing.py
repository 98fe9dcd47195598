"""Best-fit decreasing packing with a segment tree over remaining capacities.

Best-fit decreasing depends only on how many pieces there are of each length,
so the driver plans with counts, at most `capacity` rows whatever the corpus.
Open sequences are kept by the room they have left; a segment tree over the
rooms finds the tightest one that a length fits in, in logarithmic time. The
plan says, for the r-th piece of a length, which sequence and offset it has; its
rows are runs of pieces, some 20 000 for 50 thousand as for a billion pieces;
executors look their pieces up in it by binary search. A piece's r is its
place among the pieces of its length, from counts by task and running sums, so
no length's pieces are gathered anywhere.

Defined cases: a null text is an empty one, which has its end id only;
repeated rows are packed as often as they occur; a null doc_id is kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import tokens
from .shared import table, written


class Rooms:
    """Segment tree over the rooms 0..capacity: finds the least room of at least `need` that some open sequence has."""

    def __init__(self, capacity: int):
        self.n = 1 << (capacity + 1).bit_length()
        self.some = [False] * (2 * self.n)

    def put(self, room: int, some: bool) -> None:
        i = room + self.n
        self.some[i] = some
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.n
        if self.some[i]:
            return need
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces: rows (length, first rank, first sequence, offset).

    A row holds up to the next row of its length: ranks and sequences go up together, at one offset.
    """
    rooms, tree = {}, Rooms(capacity)  # room -> runs [first sequence, count]
    rows, opened = [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # new sequences, each filled with as many as fit
                each = capacity // length
                full, rest = divmod(left, each)
                for k in range(each):
                    if n := full + (k < rest):
                        rows.append((length, rank, opened, k * length))
                        rank += n
                for n, first, used in ((full, opened, each * length), (1 if rest else 0, opened + full, rest * length)):
                    if n:
                        rooms.setdefault(capacity - used, []).append([first, n])
                        tree.put(capacity - used, True)
                opened += full + bool(rest)
                left = 0
            else:
                first, n = rooms[room][-1]
                each = room // length  # a sequence just filled is the tightest, so it takes all that fit
                full = min(n, left // each)
                rest = min(left - full * each, each - 1) if full < n else 0
                for k in range(each):
                    if m := full + (k < rest):
                        rows.append((length, rank, first, capacity - room + k * length))
                        rank += m
                taken = full + bool(rest)
                if taken == n:
                    rooms[room].pop()
                    if not rooms[room]:
                        tree.put(room, False)
                else:
                    rooms[room][-1] = [first + taken, n - taken]
                for m, at, used in ((full, first, each * length), (1 if rest else 0, first + full, rest * length)):
                    if m:
                        rooms.setdefault(room - used, []).append([at, m])
                        tree.put(room - used, True)
                left -= full * each + rest
    return rows


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """Add sequence_id and offset to a written table of pieces of at most capacity.

    It needs the columns part and nth (long): nth counts a length's pieces within a part from 0.
    """
    spark = pieces.sparkSession
    counts, _ = written(pieces.groupBy("part", F.col(length_col).cast("long").alias("len")).agg((F.max("nth") + 1).alias("n")), "counts")
    by_length = {x["len"]: x["n"] for x in counts.groupBy("len").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(by_length, capacity)
    found = np.array(sorted(rows), np.int64).reshape(-1, 4)
    # one key for (length, rank), as exact as both: rank < 2**50
    keys = found[:, 0] << 50 | found[:, 1]
    before = Window.partitionBy("len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    joined = pieces.join(starts.select("part", F.col("len").alias(length_col), "base"), ["part", length_col]).drop("part")
    schema = joined.drop("nth", "base").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        for b in batches:
            length, rank = np.asarray(b.column(length_col)).astype(np.int64), np.asarray(b.column("nth")).astype(np.int64) + np.asarray(b.column("base"))
            at = np.searchsorted(keys, length << 50 | rank, "right") - 1
            cols = {x.name: b.column(x.name) for x in b.schema if x.name not in ("nth", "base")}
            cols |= {"sequence_id": pa.array(found[at, 2] + rank - found[at, 1]), "offset": pa.array(found[at, 3])}
            yield pa.RecordBatch.from_pydict(cols)

    return joined.mapInArrow(run, schema)


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end: int | None = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of whole texts, numbered as pack() needs them."""

    def run(batches):
        from pyspark import TaskContext

        part, memo = TaskContext.get().partitionId(), tokens.memo(vocabulary)
        tail = b"" if end is None else np.array([end], memo.kind).tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        wide = memo.kind.itemsize
        for b in batches:
            rows = []
            for doc, x in zip(b.column(0).to_pylist(), memo.encode_all(b.column(1)), strict=True):
                x += tail
                for k, at in enumerate(range(0, len(x), capacity * wide)):
                    own = np.frombuffer(x[at : at + capacity * wide], memo.kind).astype("<u4")
                    rows.append((doc, k, at // wide, len(own), zlib.crc32(own), int(seen[len(own)]), own.astype(np.int32) if with_ids else None))
                    seen[len(own)] += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            out.append(pa.array([part] * len(rows), pa.int64()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"]
            if with_ids:
                out.append(pa.array(cols[6], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(out, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end: int | None = 1, with_ids: bool = False) -> DataFrame:
    """Documents in sequences of at most capacity ids; only longer documents are cut.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.
    """
    return pack(written(pieces_of(docs, vocabulary, capacity, end, with_ids), "pieces")[0], capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary(), 4096, end=1)
