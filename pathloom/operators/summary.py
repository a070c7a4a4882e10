"""Summaries of a measurement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

M = "measurement_id"


def confidence(hops: DataFrame) -> DataFrame:
    """(measurement_id, n_hops, n_located, n_high, confidence)."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    out = hops.groupBy(M).agg(
        F.count("*").alias("n_hops"), F.count_if(located).alias("n_located"), F.count_if(located & (F.col("location_confidence") == "high")).alias("n_high")
    )
    ratio = F.col("n_located") / F.col("n_hops")
    level = (
        F.when(F.col("n_located") == 0, "low").when((ratio >= 0.58) & (F.col("n_high") >= F.ceil(F.col("n_located") * 0.45)), "high").when(ratio >= 0.28, "medium").otherwise("low")
    )
    return out.withColumn("confidence", level)


def averages(hops: DataFrame) -> DataFrame:
    """(measurement_id, avg_rtt_ms, avg_loss_percent), rounded; nulls are left out."""
    return hops.groupBy(M).agg(F.round(F.avg("rtt_ms")).alias("avg_rtt_ms"), F.round(F.avg("packet_loss_percent")).alias("avg_loss_percent"))


def spans(points: DataFrame) -> DataFrame:
    """(measurement_id, span): the larger side of the box around a measurement's points, in degrees."""
    side = lambda c: F.max(c) - F.min(c)
    return points.groupBy(M).agg(F.greatest(side("latitude"), side("longitude")).alias("span"))
