"""Stores: artifacts by document, records that are prepared and then validated, a cache by key, and published output.

Everything is a table of files that Spark commits as a whole; a version or a
run is a folder of its own, and readers take the latest rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.quality import latest


def write_artifact(rows: DataFrame, path: str, schema_version: str) -> str:
    """One JSON object a row, with its schema's version; a new folder for each write."""
    target = f"{path}/run={uuid.uuid4().hex}"
    rows.withColumn("schema_version", F.lit(schema_version)).write.json(target)
    return target


def read_artifact(spark: SparkSession, path: str, schema: str, schema_version: str) -> DataFrame:
    """Rows of the artifact; another version is an error."""
    rows = spark.read.schema(f"{schema}, schema_version string").option("recursiveFileLookup", "true").option("mode", "FAILFAST").json(path)
    return rows.where(F.when(F.col("schema_version") == schema_version, F.lit(True)).otherwise(F.raise_error(F.lit(f"an artifact isn't of version {schema_version}")))).drop("schema_version")


def manifest(segments: DataFrame, status: str) -> DataFrame:
    """What a protection manifest keeps of segments (doc_id, segment_id, source_text, tokens): a digest and a length, not the text."""
    kinds = F.transform("tokens", lambda t: F.struct(t["placeholder"].alias("placeholder"), t["kind"].alias("kind")))
    return segments.select("doc_id", "segment_id", F.sha2("source_text", 256).alias("source_sha256"), F.length("source_text").alias("source_chars"), kinds.alias("tokens"), F.lit(status).alias("status"))


def record(rows: DataFrame, path: str, step: int) -> None:
    """Append the rows' state at a step; the steps before stay."""
    rows.withColumn("step", F.lit(step)).write.mode("append").parquet(path)


def records(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last state of each key."""
    return latest(spark.read.parquet(path), key, F.col("step"))


def shard(key: Column) -> Column:
    return F.substring(key, 1, 2)


def write_cache(rows: DataFrame, path: str) -> None:
    """Append results (cache_key, provider, normal, compact) below the first two signs of their keys."""
    rows.withColumn("shard", shard(F.col("cache_key"))).repartition("shard").write.mode("append").partitionBy("shard").json(path)


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, errors): one row a key, and the count of rows that can't be read, which are misses."""
    rows = spark.read.schema("cache_key string, provider string, normal string, compact string, shard string, _corrupt_record string").json(path)
    good = F.col("_corrupt_record").isNull() & F.col("cache_key").isNotNull() & (shard(F.col("cache_key")) == F.col("shard")) & (F.trim(F.coalesce("normal", F.lit(""))) != "")
    errors = rows.select((~F.coalesce(good, F.lit(False))).alias("bad")).agg(F.count_if("bad").alias("cache_errors"))
    return rows.where(good).groupBy("cache_key").agg(F.min_by(F.struct("provider", "normal", "compact"), F.struct("normal", "compact")).alias("r")).select("cache_key", "r.*"), errors
