"""Helpers that several operators use: the shared work folder, written
intermediate tables, byte words and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset,
    as in tests on one machine, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_open: list[list[str]] = []  # tables written in each scratch() that is at work


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written() inside are deleted at the end, but for those to keep."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop_path(spark, path)


def written(df: DataFrame, name: str, by: list[str] | None = None, keep: bool = False) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    keep: for results that outlive the scratch() around.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bytes of rows that are broadcast at most; beyond it, joins shuffle.
FEW_BYTES = 64 << 20


def few(df: DataFrame, most: int = FEW_BYTES) -> DataFrame:
    """A written table of fixed-width columns, to be broadcast if its counted rows, at 16 bytes and 8 a column, are few bytes."""
    return F.broadcast(df) if df.count() * (16 + 8 * len(df.columns)) <= most else df


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores behind them as long as a column of `taken` has the same one, in any case."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(uri: str) -> tuple[object, str]:
    """The file system and the path of a shared folder, for files that Spark has no writer for."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


# ---------------------------------------------------------------- components


def star_forest(a, b):
    """Shrink the links (a, b), numpy arrays of ids, to links (node, smallest id of its part): a spanning star per part."""
    import numpy as np

    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(ids))
    u, v = flat[: len(a)], flat[len(a) :]
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    node = np.flatnonzero(root != np.arange(len(ids)))
    return ids[node], ids[root[node]]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b), longs: a row (node, component) for each id in an edge.

    component is the smallest id that can be reached. Alternates large-star and
    small-star steps; every round is written to the shared folder, so a round
    costs one reread after the loss of an executor. Minima are aggregated
    before the shuffle and only joined afterwards, so no node's neighbours are
    gathered in one place.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, mid = written(large, "edges")
        # here a > b: a star step over the smaller neighbours
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct()
        after, new = written(small, "edges")
        drop_path(spark, path)
        drop_path(spark, mid)
        now, path = after, new
        # a star forest, each node with one edge to a root that has none itself, is a fixed point
        seen = tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
