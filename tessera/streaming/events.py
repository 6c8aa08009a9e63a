"""Event streams: latest event per key and guarded progress, for batch and Structured Streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import greatest_before


def latest(events: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The last event of each key. One aggregate with partial maxima: the same plan serves a stream in update mode."""
    rest = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return events.groupBy(key).agg(last).select(key, *[F.col("_last").getField(c).alias(c) for c in rest])


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped in a stream."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def progress(updates: DataFrame, key: str, order: tuple[str, ...], value: str, terminal: str, bucket: Column) -> DataFrame:
    """Progress that never falls, at most 99 before success, nothing after the first terminal update.

    updates: key, order, value from 0 to 100, terminal (null, "success" or "failure"); rows that add nothing go. bucket as
    for joins.greatest_before, so a hot key is ordered bucket by bucket.
    """
    own = F.greatest(F.lit(0), F.col(value).cast("int"))
    rows = greatest_before(updates, key, order, bucket, {"last": own, "ended": F.when(F.col(terminal).isNotNull(), 1)})
    shown = F.when(F.col(terminal) == "success", 100).otherwise(F.least(F.lit(99), F.greatest(own, "last")))
    rows = rows.filter("ended is null").withColumn("shown", shown)
    return rows.filter(F.col("last").isNull() | (F.col("shown") > F.least(F.lit(99), F.col("last")))).drop("ended", "last")
