"""Measurement requests and what becomes of them: where to measure, how, whether to try again, when it is over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import text as t

# Probe regions by parts of a visitor's time zone, first match wins; the packets of an MTR request.
REGIONS = [("Seoul", "South Korea"), ("Tokyo", "Japan"), ("Singapore", "Singapore"), ("Los_Angeles", "California"), ("New_York", "New York")]
MTR_PACKETS = 16
LONGEST_ZONE, LONGEST_LOCALE = 80, 40


def probe_region(time_zone: Column, locale: Column) -> Column:
    """Where to look for a probe. A locale that has "ko" counts as Korean before any other time zone does."""
    zone, korean = F.coalesce(time_zone, F.lit("")), F.contains(F.lower(F.coalesce(locale, F.lit(""))), F.lit("ko"))
    out = F.when(korean, F.lit("South Korea"))
    for part, region in REGIONS:
        out = out.when(F.contains(zone, F.lit(part)), F.lit(region))
    return out.otherwise(F.lit("World"))


def measurement_type(mode: Column) -> Column:
    return F.when(mode == "traceout", "traceroute").otherwise("mtr")


def protocols(mode: Column) -> Column:
    """The protocols to try, in order."""
    return F.when(mode == "mtr", F.array(F.lit("ICMP"), F.lit("TCP"))).otherwise(F.array(F.lit("ICMP")))


def options(mode: Column, protocol: Column) -> Column:
    """A struct of the options; packets is null unless in MTR mode."""
    mtr = F.coalesce(mode == "mtr", F.lit(False))
    return F.struct(F.when(mtr, protocol).otherwise("ICMP").alias("protocol"), F.when(mtr, MTR_PACKETS).alias("packets"))


def request_body(target: Column, mode: Column, protocol: Column, region: Column) -> Column:
    """The JSON of a request for one measurement."""
    where = F.array(F.struct(region.alias("magic")))
    return F.to_json(F.struct(measurement_type(mode).alias("type"), target.alias("target"), where.alias("locations"), F.lit(1).alias("limit"), options(mode, protocol).alias("measurementOptions")))


def retries_with(mode: Column, index: Column, failure: Column) -> Column:
    """The place of the protocol to try next after a failure, from 0; null if there is no other try."""
    said = F.lower(failure)
    refused = F.contains(said, F.lit("private ip ranges")) | F.contains(said, F.lit("not allowed"))
    return F.when((mode == "mtr") & (F.get(protocols(mode), index) == "ICMP") & refused & (index + 1 < F.size(protocols(mode))), index + 1)


def is_over(status: Column, n_hops: Column) -> Column:
    """Whether a poll shows the end: by its status, or because hops are there."""
    return F.coalesce(status.isin("finished", "completed"), F.lit(False)) | F.coalesce(n_hops > 0, F.lit(False))


def is_busy(status: Column) -> Column:
    return F.coalesce(status.isin("starting", "running"), F.lit(False))


def journey(searched: Column, busy: Column, launching: Column, shown: Column) -> Column:
    return F.when(~searched, "idle").when(~shown | busy | launching, "launch").otherwise("settled")


def client_key(ip: Column, address: Column) -> Column:
    return F.coalesce(t.or_null(ip), t.or_null(address), F.lit("unknown"))


def visitor(time_zone: Column, locale: Column) -> Column:
    """What is kept of a visitor's time zone and locale."""
    return F.struct(F.substring(time_zone, 1, LONGEST_ZONE).alias("time_zone"), F.substring(locale, 1, LONGEST_LOCALE).alias("locale"))


def first_results(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads with the JSON of the first of their results in place of the column; null if there is none."""
    first = F.expr(f"to_json(try_variant_get(try_parse_json(`{column}`), '$.results[0]', 'variant'))")
    return payloads.withColumn(column, first)


def probe_sources(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads with column source: where a result was measured; fields of the wrong kind are null."""
    kind = lambda k: f"schema_of_variant(try_variant_get(v, '$.probe.{k}', 'variant'))"
    text = lambda k: f"case when {kind(k)} = 'STRING' then try_variant_get(v, '$.probe.{k}', 'string') end"
    number = lambda k: f"case when {kind(k)} in ('BIGINT', 'DOUBLE', 'FLOAT') or startswith({kind(k)}, 'DECIMAL') then try_variant_get(v, '$.probe.{k}', 'double') end"
    out = payloads.withColumn("v", F.try_parse_json(column))
    asn = t.normal_asn(F.expr("case when " + kind("asn") + " in ('BIGINT', 'STRING') then try_variant_get(v, '$.probe.asn', 'string') end"))
    source = F.struct(
        F.expr(text("id")).alias("probe_id"), F.expr(text("city")).alias("city"), F.expr(text("country")).alias("country"), asn.alias("asn"),
        F.expr(number("latitude")).alias("latitude"), F.expr(number("longitude")).alias("longitude"),
    )
    return out.withColumn("source", source).drop("v")
