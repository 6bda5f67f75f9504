"""Awareness and deduplication as streams.

The earliest chapter per (fact, knower) is a minimum, so it comes out the same in whatever order events arrive, and late
events need no watermark: update mode emits a pair again when it moves earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def earliest(events: DataFrame) -> DataFrame:
    """``events(fact_id, knower, learned_at)``, streaming or not, to the earliest chapter of each pair."""
    return events.groupBy("fact_id", "knower").agg(F.min("learned_at").alias("learned_at"))


def run(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each batch's moved pairs; reading them back, the minimum per pair is the state of the table."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    writer = earliest(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_texts(chapters: DataFrame, delay: str) -> DataFrame:
    """One chapter per fingerprint within a watermark: ``chapters(ts, print, ...)``.  Which of two equal texts stays is the
    order of arrival here; use the batch operator where the order of the works decides."""
    return chapters.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["print"])
