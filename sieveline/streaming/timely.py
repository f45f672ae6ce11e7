"""Decisions over a stream whose events may come twice, or late.

An event is decided once: by its id, within the watermark's delay. What isn't
decided is kept in a side table, so no event is lost: of those the ones whose
id was decided came again, the others came too late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.events import decide_events
from ..sources.rules import Rule

_DECIDED, _REST = "decided", "undecided"


def event_key(event_id: Column, value: Column) -> Column:
    """An event's id, or what its text gives where it has none."""
    return F.coalesce(event_id.cast("string"), F.concat(F.lit("sha256:"), F.sha2(F.coalesce(value, F.lit("")), 256)))


def write_timely_decisions(events: DataFrame, rules: list[Rule], path: str, checkpoint: str, delay: str = "10 minutes", once: bool = True, **options) -> StreamingQuery:
    """Append the decisions of a stream ``value, event_id, time`` to ``path``, each event's once.

    The state holds an id for ``delay`` after its time and is bounded by that.
    Events older than the watermark (the greatest time less ``delay``) aren't
    decided, as Spark tells them: by the watermark that held in the micro-batch
    before, so one that is late by that of this one may still be. Nor are those
    whose id was decided within the delay, nor those without a time; they go to
    a side table with their values. An event without
    an id is known by its text. Each micro-batch is written under its own
    number, so one that runs again replaces its rows. ``checkpoint`` has to be
    a folder that all executors share.
    """
    keyed = events.select("value", event_key(F.col("event_id"), F.col("value")).alias("event_id"), F.col("time").cast("timestamp").alias("time"))
    timely = keyed.where("time is not null").withWatermark("time", delay).dropDuplicatesWithinWatermark(["event_id"])
    both = keyed.withColumn("first", F.lit(False)).union(timely.withColumn("first", F.lit(True)))

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        cached: list[DataFrame] = [held]
        first = held.where("first").drop("first")
        decided = decide_events(first, rules, cached=cached, **options).drop("matches")
        decided.write.mode("overwrite").parquet(f"{path}/{_DECIDED}/batch={number}")
        rest = held.where("not first").drop("first").join(first.select("event_id"), "event_id", "left_anti")
        rest.write.mode("overwrite").parquet(f"{path}/{_REST}/batch={number}")
        for table in cached:
            table.unpersist()

    writer = both.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_DECIDED}")


def late_events(spark: SparkSession, path: str) -> DataFrame:
    """``event_id, value, time, batch`` of the events that came too late to be decided, or without a time; a late event that came again is there again."""
    rest = spark.read.parquet(f"{path}/{_REST}")
    return rest.join(decisions(spark, path).select("event_id"), "event_id", "left_anti").select("event_id", "value", "time", "batch")


def repeated_events(spark: SparkSession, path: str) -> DataFrame:
    """``event_id, value, time, batch`` of events whose id was decided in another micro-batch; copies within one micro-batch aren't told."""
    rest = spark.read.parquet(f"{path}/{_REST}")
    return rest.join(decisions(spark, path).select("event_id"), "event_id", "left_semi").select("event_id", "value", "time", "batch")
