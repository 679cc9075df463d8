"""The event log as a stream: fixed days, job states, suppressed duplicates."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of its files, with event times as instants."""
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily(stream: DataFrame) -> DataFrame:
    """Count and sum of each UTC day and type; rows later than 48 hours are not awaited."""
    by = stream.withWatermark("ts", "48 hours").groupBy(F.window("ts", "1 day"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def job_state(stream: DataFrame) -> DataFrame:
    """The newest event of each job, and how many there were."""
    return stream.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("n"))


def distinct_requests(stream: DataFrame, keys: tuple[str, ...] = ("user_id", "event_type"), within: str | None = None) -> DataFrame:
    """The first request of each key. Keys are remembered for as long as `within` says, or for good if it is not given."""
    if within is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(list(keys))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return folder or tempfile.mkdtemp(prefix="lodestone-")


def run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Drains what the source holds now, and returns the sink's rows. Rows and progress are written to the shared folder, a
    repeated batch over its first try; in complete mode the last batch holds all rows, else every batch adds its own."""
    folder = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{'all' if mode == 'complete' else number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/none")
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/*")


#: Where a job may go from each state.
NEXT = {None: {"queued"}, "queued": {"running", "cancelled", "interrupted"}, "running": {"succeeded", "failed", "cancelled", "interrupted"}}


def job_machine(stream: DataFrame) -> DataFrame:
    """(job, state, ignored): each job's state after its events (job, state, seq), and how many could not follow.

    A job is queued, then runs, then ends; events that don't fit are counted and change nothing. The state of a job is two
    values, kept by Spark across triggers.
    """

    def step(key, frames, state: GroupState):
        now, ignored = state.get if state.exists else (None, 0)
        for frame in frames:
            for new in frame.sort_values("seq")["state"]:
                if new in NEXT.get(now, set()):
                    now = new
                else:
                    ignored += 1
        state.update((now, ignored))
        yield pd.DataFrame({"job": [key[0]], "state": [now], "ignored": [ignored]})

    return stream.groupBy("job").applyInPandasWithState(step, "job long, state string, ignored long", "state string, ignored long", "update", GroupStateTimeout.NoTimeout)


def newest_only(stream: DataFrame, key: str, order: str, path: str) -> StreamingQuery:
    """Writes each batch's newest row of every key, replacing what the key had: progress of which only the last state counts."""

    def write(batch: DataFrame, number: int) -> None:
        rows = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rows), order).alias("x")).select(key, "x.*")
        old = f"{path}/{number - 1}"
        if number:
            before = batch.sparkSession.read.parquet(old)
            last = last.unionByName(before.join(last.select(key), key, "left_anti"))
        last.write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start()


def backfill(stream: DataFrame, path: str) -> StreamingQuery:
    """Appends what the source has that was not appended yet; a second run adds only what came since."""
    return stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_progress").option("path", f"{path}/rows").trigger(availableNow=True).start()


def stage_times(stream: DataFrame) -> DataFrame:
    """(run, stage, started, ended) of stages from their first and last event."""
    return stream.groupBy("run", "stage").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
