"""Streaming counters: reviews to item ratings, block-listed operations, windowed event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_ratings(reviews: DataFrame, item: str, stars: str) -> DataFrame:
    """Sum and count of stars per item, for update or complete mode; reviews without stars are left out."""
    return reviews.where(F.col(stars).isNotNull()).groupBy(item).agg(F.sum(stars).alias("rating_stars"), F.count("*").alias("rating_count"))


def filtered_operations(ops: DataFrame, keep: Column) -> DataFrame:
    """Operations that pass; a stream stays a stream."""
    return ops.where(keep)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """W9 (an extension): counts per tumbling window and key; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source holds now and return its state as a table under ``path``.

    Each micro-batch's state is written in parallel to a folder of its own; the last one is the state.
    """
    last: list[int] = []

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state={batch_id}")
        last[:] = [batch_id]

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/state={last[0]}" if last else path)


def merged_each_batch(stream: DataFrame, path: str, checkpoint: str, key: str, counters: list[str]):
    """Add each micro-batch's counts to a table under ``path``, one folder a batch.

    A batch writes ``batch=<id>`` in overwrite mode: a batch that is run again replaces itself, so
    counts stay exact; the totals are the sum over folders (:func:`batch_totals`).
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(key).agg(*[F.sum(c).alias(c) for c in counters]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batch_totals(spark, path: str, key: str, counters: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(key).agg(*[F.sum(c).alias(c) for c in counters])
