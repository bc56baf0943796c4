"""The event tail as a stream: new files of events, each job's latest state."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import tables


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Job events from Parquet files as they come into ``path``."""
    return tables.job_events(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))


def append_tail(spark: SparkSession, path: str, out: str, checkpoint: str, after: int = -1) -> None:
    """Append all new events after an id to ``out`` and stop; a restart goes on where it ended."""
    stream = event_stream(spark, path).where(F.col("event_id") > after)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


TERMINAL = ("completed", "failed", "cancelled")


def follow(spark: SparkSession, path: str, job_id: str, checkpoint: str, show: Callable[[DataFrame], None], poll_s: float = 1.0, most_idle: int = 60) -> bool:
    """Shows a job's new events as they come, until its last one is terminal (true) or nothing came for ``most_idle`` polls (false).

    Each micro-batch keeps one number: whether the job has ended.
    """
    seen = {"idle": 0, "ended": False}

    def batch(events: DataFrame, _: int) -> None:
        own = events.where(F.col("job_id") == job_id)
        last = own.agg(F.count("*").alias("n"), F.max(F.col("status").isin(*TERMINAL)).alias("ended")).first()
        seen["idle"] = 0 if last["n"] else seen["idle"] + 1
        seen["ended"] = seen["ended"] or bool(last["ended"])
        if last["n"]:
            show(own)

    while not seen["ended"] and seen["idle"] < most_idle:
        before = dict(seen)
        query = event_stream(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if seen == before:
            seen["idle"] += 1  # no new files, so no batch
        if not seen["ended"]:
            time.sleep(poll_s)
    return seen["ended"]
