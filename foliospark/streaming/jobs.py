"""Job states from a stream of events: the last state of each task, kept in a table by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import latest

#: A state can be followed by the ones behind it.
STATES = ("queued", "running", "completed", "review", "failed")


def state_of(event_type: F.Column) -> F.Column:
    return F.when(event_type == "signup", "queued").when(event_type == "view", "running").when(event_type == "purchase", "completed").when(event_type == "error", "failed").otherwise("review")


def read_events(spark: SparkSession, path: str, schema, files_at_once: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def job_states(events: DataFrame) -> DataFrame:
    """(user_id, event_id, ts, state) of each task's last event."""
    rows = events.select("user_id", "event_id", "ts", state_of(F.col("event_type")).alias("state"))
    return latest(rows, "user_id", F.col("ts"), F.col("event_id"))


def run_job_states(events: DataFrame, path: str, checkpoint: str, compact: int = 16) -> StreamingQuery:
    """Write each batch's last states below path/batch; a batch that is repeated overwrites its own folder, so states are exact.

    Every compact-th batch writes all current states below path/base besides,
    so readers need one base and the few batches after it.
    """

    def save(batch: DataFrame, n: int) -> None:
        job_states(batch).write.mode("overwrite").parquet(f"{path}/batch/n={n}")
        if n % compact == compact - 1:
            current_states(batch.sparkSession, path, upto=n).write.mode("overwrite").parquet(f"{path}/base/n={n}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The last state of each task, of the last base and the batches after it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/base")
    done = [-1]
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at):
        names = [x.getPath().getName() for x in files.listStatus(at)]
        done += [n for n in (int(x[2:]) for x in names if x.startswith("n=")) if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/base/n={n}/_SUCCESS")) and (upto is None or n < upto)]
    last = max(done)
    rows = spark.read.parquet(f"{path}/batch").where(F.col("n") > last)
    rows = (rows if upto is None else rows.where(F.col("n") <= upto)).drop("n")
    if last >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{path}/base/n={last}"))
    return latest(rows, "user_id", F.col("ts"), F.col("event_id"))


def transitions(events: DataFrame) -> DataFrame:
    """(user_id, event_id, before, state, allowed): each change of a task's state, and whether it may happen."""
    rows = events.select("user_id", "event_id", "ts", state_of(F.col("event_type")).alias("state"))
    rows = rows.withColumn("before", F.lag("state").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    place = lambda c: F.array_position(F.array(*map(F.lit, STATES)), c)
    ends = F.col("before").isin("completed", "review", "failed")
    return rows.where("before IS NOT NULL AND before <> state").select("user_id", "event_id", "before", "state", (~ends & (place(F.col("state")) > place(F.col("before")))).alias("allowed"))


def settled(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """The last event of each burst: events of a user that follow each other within a gap; a stream gives it once the watermark has passed."""
    return with_time(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("burst"), "user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def with_time(events: DataFrame) -> DataFrame:
    """Watermarks need times with a zone; those without one are in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def events_by_window(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events of each type in windows of event time; rows later than the watermark are left out by a stream."""
    return with_time(events).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
