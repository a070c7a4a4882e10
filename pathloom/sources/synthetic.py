"""A synthetic measurement source: five hops, and in MTR mode four rounds of metric updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hop number, network, host, address, offset of the latency, jitter, loss in MTR mode, status; 5 is the target's.
HOPS = [
    (1, "AS???", "nearby-probe.local", "10.18.0.1", 0, 2, 0, "ok"),
    (2, "AS???", "edge-gateway.net", "172.18.42.1", 6, 3, 0, "ok"),
    (3, "AS64512", "regional-exchange.net", "203.0.113.14", 18, 5, 1, "ok"),
    (4, "AS3356", "transit-backbone.example", "198.51.100.35", 48, 9, 2, "slow"),
    (5, None, None, None, 58, 6, 0, "ok"),
]
ROUNDS = 4


def origin(time_zone: Column, locale: Column) -> tuple[Column, Column]:
    """(city, country) of the probe for a visitor."""
    seoul = F.coalesce(F.contains(time_zone, F.lit("Seoul")), F.lit(False)) | F.coalesce(F.contains(F.lower(locale), F.lit("ko")), F.lit(False))
    tokyo = F.coalesce(F.contains(time_zone, F.lit("Tokyo")), F.lit(False))
    city = F.when(seoul, "Seoul").when(tokyo, "Tokyo").otherwise("Nearest available city")
    return city, F.when(seoul, "South Korea").when(tokyo, "Japan").otherwise("Estimated region")


def base_latency(target: Column) -> Column:
    return F.when(target == "1.1.1.1", 13).when(F.contains(target, F.lit("google")), 22).otherwise(31)


def hops(requests: DataFrame) -> DataFrame:
    """Hops of requests (measurement_id, target, mode): every column of requests and the hop's."""
    spark: SparkSession = requests.sparkSession
    rows = spark.createDataFrame(HOPS, "hop_number int, asn string, hostname string, ip string, plus int, jitter int, mtr_loss int, status string")
    # Five literal rows for each request.
    out = requests.join(F.broadcast(rows))
    target = F.col("target")
    last = F.col("hop_number") == 5
    return out.withColumns({
        "asn": F.when(last, F.when(F.contains(target, F.lit("google")), "AS15169").when(target == "1.1.1.1", "AS13335").otherwise("AS8560")).otherwise(F.col("asn")),
        "hostname": F.when(last, F.concat(F.lit("edge."), target)).otherwise(F.col("hostname")),
        "ip": F.when(last, F.when(target == "1.1.1.1", target).otherwise("192.0.2.80")).otherwise(F.col("ip")),
        "rtt_ms": (base_latency(target) + F.col("plus")).cast("double"), "jitter_ms": F.col("jitter").cast("double"),
        "packet_loss_percent": F.when(F.col("mode") == "mtr", F.col("mtr_loss")).otherwise(0).cast("double"),
    }).drop("plus", "jitter", "mtr_loss")


def metric_updates(hops_: DataFrame) -> DataFrame:
    """(measurement_id, round, hop_number, rtt_ms, jitter_ms): what MTR requests send after their hops."""
    rows = hops_.where(F.col("mode") == "mtr").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))))
    drift = (F.col("round") + F.col("hop_number")) % 3
    return rows.select("measurement_id", "round", "hop_number", F.round(F.col("rtt_ms") + drift * 3).alias("rtt_ms"), F.round(F.col("jitter_ms") + drift).alias("jitter_ms"))
