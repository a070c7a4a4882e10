"""The driver's tables as measurements, hops, sources, events and targets.

The tables hold no network data, so each model follows a fixed rule; plans/oracle.py has the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.net import NOT_LOOKED_UP, ip_number
from pathloom.operators.decode import hop_status
from pathloom.operators.prefixes import cidr_prefixes, outside
from pathloom.sources import dims

#: The full key of a line: the only order of an order's lines that has no ties.
LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

#: The columns of a source's place.
SOURCE = ("src_city", "src_country", "src_latitude", "src_longitude")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to as many partitions as the session shuffles to, for work that costs much for each byte: partitions are
    not merged for being small, and an aggregate by these keys needs no further exchange."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _pick(index, values):
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def hops(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """A hop for each line of an order, which is the measurement. dealt: measurements are spread, for work that costs much for each byte."""
    # Lines are dealt out by the measurement's own key, so that what follows by measurement needs no further exchange.
    line = table(spark, sf_dir, "lineitem").withColumn("measurement_id", F.col("l_orderkey").cast("string"))
    line = spread(line, "measurement_id") if dealt else line
    order = Window.partitionBy("measurement_id").orderBy(*LINE_KEY)
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    kind, place = p % 6, s % 22
    ip = (
        F.when(kind == 0, F.concat_ws(".", F.lit("10"), s % 200, p % 250, F.lit("1")))
        .when(kind == 1, F.concat_ws(".", F.lit("172"), 10 + s % 30, p % 250, F.lit("2")))
        .when(kind == 2, F.concat_ws(".", F.lit("142.250"), s % 200, p % 250))
        .when(kind == 3, F.concat_ws(".", F.lit("203.0"), s % 200, p % 250))
        .when(kind == 4, F.concat_ws(".", F.lit("82.165"), s % 200, p % 250))
    )
    host = F.when(p % 5 != 0, F.concat(F.lit("ae1-"), _pick(p % 21, [c[4][0] for c in dims.CITIES]), (s % 9).cast("string"), F.lit(".core.example.net")))
    asn = F.when(s % 10 == 8, F.lit("AS???")).when(s % 10 == 9, F.concat(F.lit("AS"), (1000 + s).cast("string"))).otherwise(_pick(s % 10, [n[0] for n in dims.NETWORKS] * 2))
    located = (place < 21) & (F.col("l_linestatus") == "F")
    rtt = F.when(p % 11 != 0, F.col("l_quantity") * 4)
    loss = F.when(p % 13 != 0, F.round(F.col("l_discount") * 1000))
    at = F.least(place, F.lit(20))
    return line.select(
        "measurement_id", F.row_number().over(order).alias("hop_seq"), F.row_number().over(order).alias("hop_number"),
        asn.alias("asn"), F.lit(None).cast("string").alias("as_name"), ip.alias("ip"), host.alias("hostname"),
        F.when(place < 21, _pick(at, [c[0] for c in dims.CITIES])).alias("city"), F.when(place < 21, _pick(at, [c[1] for c in dims.CITIES])).alias("country"),
        F.when(located, _pick(at, [c[2] for c in dims.CITIES])).alias("latitude"), F.when(located, _pick(at, [c[3] for c in dims.CITIES])).alias("longitude"),
        F.when(p % 3 == 0, F.lit("medium")).otherwise(F.lit("high")).alias("location_confidence"),
        rtt.alias("rtt_ms"), (F.col("l_tax") * 100).cast("int").cast("double").alias("jitter_ms"), loss.alias("packet_loss_percent"), hop_status(rtt, loss).alias("status"),
    )


def source_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(measurement_id, at): the number of the place where the order's customer is."""
    nation = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 21).alias("at"))
    o = table(spark, sf_dir, "orders").join(nation, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").cast("string").alias("measurement_id"), "at")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(measurement_id, src_city, src_country, src_latitude, src_longitude): where the order's customer is."""
    city = [_pick(F.col("at"), [c[i] for c in dims.CITIES]) for i in range(4)]
    return source_places(spark, sf_dir).select("measurement_id", *(c.alias(n) for c, n in zip(city, SOURCE)))


def ip_geo(hops_: DataFrame) -> DataFrame:
    """A lookup record for each distinct public address of the hops."""
    ips = outside(hops_, "ip", cidr_prefixes(dims.ranges(hops_.sparkSession, NOT_LOOKED_UP)))
    n = ip_number(F.col("ip"))
    at = (F.shiftright(n, 24) + F.shiftright(n, 16) % 256 + F.shiftright(n, 8) % 256 + n % 256) % 21
    return ips.select(
        "ip", _pick(at, [c[0] for c in dims.CITIES]).alias("geo_city"), _pick(at, [c[1] for c in dims.CITIES]).alias("geo_country"),
        (_pick(at, [c[2] for c in dims.CITIES]) + 0.25).alias("geo_latitude"), (_pick(at, [c[3] for c in dims.CITIES]) - 0.25).alias("geo_longitude"),
        # Never null, so that a test for that isn't worked out for each hop.
        F.concat(F.lit("geo-"), F.coalesce(_pick((at + 1) % 21, [c[4][0] for c in dims.CITIES]), F.lit("")), F.lit(".example.org")).alias("geo_hostname"),
        F.when(at % 3 != 0, F.concat(F.lit("AS"), (2000 + at).cast("string"))).alias("geo_asn"), F.when(at % 3 != 1, F.concat(F.lit("Geo network "), at.cast("string"))).alias("geo_as_name"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events: (session_id, seq, ts_ms, type, hop_number, some hop fields, hops): started and finished ones carry a list."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for x in ("signup", "measurement_started", "view", "hop_result", "click", "metric_update", "purchase", "measurement_finished", "error", "error")))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        F.col("user_id").alias("session_id"), seq.alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.element_at(kind, F.col("event_type")).alias("type"),
        (k % 8 + 1).alias("hop_number"), F.when(k % 4 != 0, F.col("value")).alias("rtt_ms"), F.when(k % 3 != 0, F.concat(F.lit("h"), k.cast("string"))).alias("hostname"),
        F.when(k % 5 != 0, F.col("value") / 2).alias("jitter_ms"), F.when(k % 7 != 0, (k % 100).cast("double")).alias("packet_loss_percent"),
        F.when(k % 2 == 0, F.concat(F.lit("AS"), k.cast("string"))).alias("asn"), F.when(k % 11 != 0, _pick(k % 4, ("ok", "slow", "loss", "timeout"))).alias("status"),
        F.when(F.col("event_type").isin("signup", "purchase"), F.slice(F.array(*(_listed_hop(i, k) for i in (1, 2, 3))), 1, k % 4)).alias("hops"),
    )


def _listed_hop(i: int, k):
    return F.struct(F.lit(i).alias("hop_number"), (F.col("value") + i).alias("rtt_ms"), F.when(k % 3 != i % 3, F.lit(f"p{i}")).alias("hostname"), F.lit("ok").alias("status"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client, ts_ms, seq) of the rate limiter."""
    return events(spark, sf_dir).select(F.col("session_id").alias("client"), "ts_ms", "seq")
