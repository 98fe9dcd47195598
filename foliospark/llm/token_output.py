"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

Every text's ids are replaced by their rank in the corpus (0 is the most
frequent id) and written with one to four data bytes each; two bits an id, four
ids a control byte, say how many. Control and data bytes lie apart, so numpy
decodes a block with one table lookup for the lengths and one gather.

A file holds the documents of one range of ids, in ascending order, as blocks:

    magic "FSV2", documents u4, ids u8, control bytes u8, data bytes u8,
    documents without id u8, document ids i8[], ids in each u4[], control
    bytes, data bytes

all little-endian; documents without id are a block's first. Files, their counts and the table from rank to id are listed in a
manifest that Spark commits, so files of failed attempts are never read.

Defined cases: a null or empty text has the end id only; a null doc_id sorts
first and is read back as null; repeated rows and equal ids stay, in the order
of (doc_id, a hash of the ids), and may lie in several files; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import tokens
from .shared import drop_path, local_path, new_path, table, written

MAGIC = b"FSV2"
HEAD = 40
BLOCK_IDS = 1 << 20  # ids in a block, but for a longer document
FILE_IDS = 1 << 22  # ids aimed at in a file

#: Control byte -> lengths of its four values.
LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], 1).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    wide = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-len(values) % 4 + len(values), np.uint8)
    codes[: len(values)] = wide - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) < wide[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of encode_values, as unsigned 32-bit integers."""
    wide = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < wide[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def _block(ids: list, parts: list[bytes], kind: np.dtype, rank: np.ndarray) -> bytes:
    counts = np.array([len(x) // kind.itemsize for x in parts], "<u4")
    control, data = encode_values(rank[np.frombuffer(b"".join(parts), kind)])
    head = np.array([int(counts.sum()), len(control), len(data), ids.count(None)], "<u8")
    at = np.array([x or 0 for x in ids], "<i8")
    return b"".join([MAGIC, np.array([len(ids)], "<u4").tobytes(), head.tobytes(), at.tobytes(), counts.tobytes(), control, data])


def read_blocks(stream) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(document ids, ids in each, ranks of all) of each block of an open file."""
    while head := stream.read(HEAD):
        if head[:4] != MAGIC or len(head) < HEAD:
            raise ValueError("not a token file, or cut short")
        docs = int(np.frombuffer(head[4:8], "<u4")[0])
        n, control, data, without = (int(x) for x in np.frombuffer(head[8:], "<u8"))
        ids, counts = np.frombuffer(stream.read(8 * docs), "<i8"), np.frombuffer(stream.read(4 * docs), "<u4")
        yield pa.array(ids, pa.int64(), mask=np.arange(docs) < without), counts, decode_values(stream.read(control), stream.read(data), n)


def tokenize(docs: DataFrame, path: str, end: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's ids as little-endian bytes, with the end id."""

    def run(batches):
        memo = tokens.memo(path)
        tail = b"" if end is None else np.array([end], memo.kind).tobytes()
        for b in batches:
            out = [x + tail for x in memo.encode_all(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def ranks(ids: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """rank[id] by falling frequency, ties by id; one partial count an id and task, at most `size` rows in the end."""

    def run(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            x = b.column(0).cast(pa.binary())
            ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset :]
            n += np.bincount(np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[len(x)]].view(kind), minlength=size) if len(x) else 0
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(n[at])], ["id", "n"])

    n = np.zeros(size, np.int64)
    for x in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        n[x["id"]] = x["n"]
    order = np.lexsort((np.arange(size), -n))
    rank = np.empty(size, "<u4")
    rank[order] = np.arange(size)
    return rank, int(n.sum())


def write_files(docs: DataFrame, folder: str, vocabulary: str, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents into files below folder, which driver and executors share.

    Returns the committed manifest, also kept at folder/manifest: shard, path,
    docs, ids, start (ids of all shards before it). folder/ranks has (rank, id).
    """
    spark = docs.sparkSession
    made = tokens.Memo(vocabulary)
    kind, size = made.kind, made.tokenizer.get_vocab_size()
    del made
    ids, temp = written(tokenize(docs, vocabulary, end, id_col, text_col), "ids")
    rank, total = ranks(ids, kind, size)
    spark.createDataFrame([(int(rank[i]), i) for i in range(size)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    parts = max(1, -(-total // FILE_IDS))

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        files, root = local_path(folder)
        files.create_dir(f"{root}/files", recursive=True)
        name = f"{root}/files/{shard:07d}-{uuid.uuid4().hex}.fsv"  # another attempt writes another file
        n_docs = n_ids = 0
        own, data, size = [], [], 0
        with files.open_output_stream(name) as out:
            for b in batches:
                for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own.append(key)
                    data.append(x)
                    size += len(x) // kind.itemsize
                    if size >= BLOCK_IDS:
                        out.write(_block(own, data, kind, rank))
                        n_docs, n_ids, own, data, size = n_docs + len(own), n_ids + size, [], [], 0
            if own:
                out.write(_block(own, data, kind, rank))
                n_docs, n_ids = n_docs + len(own), n_ids + size
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["shard", "path", "docs", "ids"])

    # rows of one id, and equal rows, are parted by their place in the written table
    order = [F.col("doc_id").asc_nulls_first(), "hash", "place"]
    placed = ids.withColumns({"hash": F.xxhash64("ids"), "place": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(run, "shard long, path string, docs long, ids long").write.parquet(f"{folder}/shards")
    drop_path(spark, temp)
    # one row a file, so this window has a row for each four million ids
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(f"{folder}/shards").where("docs > 0").withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    shards.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of int)."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    back = [x["id"] for x in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]  # as many as the vocabulary
    to_id = np.array(back, "<u4")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))][: 5 if with_ids else 4]

    def run(batches):
        files, _ = local_path(folder)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_stream(path) as stream:
                    for docs, counts, values in read_blocks(stream):
                        ids = to_id[values]
                        ends = counts.astype(np.int64).cumsum()
                        starts = ends - counts
                        data = memoryview(ids.tobytes())
                        crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
                        cols = [docs, pa.array(start + starts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))
                        start += int(ends[-1])

    n = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return manifest.select("path", "start").repartition(n).mapInArrow(run, schema)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    write_files(table(spark, sf_dir, "documents"), folder, tokens.vocabulary(), end=2)
    return read_files(spark, folder, with_ids=False)
