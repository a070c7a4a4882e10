"""Address lookups: records of two vendors' shapes to one dimension table, a row for each address."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import text as t


def vendor(env: Mapping[str, str]) -> str:
    """Which vendor's records are used: as GEOIP_PROVIDER says if it names one, else by whether there is a token."""
    named = env.get("GEOIP_PROVIDER")
    if named in ("none", "ipinfo", "ip-api"):
        return named
    return "ipinfo" if env.get("IPINFO_TOKEN") else "none"


def _finite(c: F.Column) -> F.Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def joined_coordinates(records: DataFrame) -> DataFrame:
    """ip_geo rows from records (ip, loc "lat,lon", org, city, country, hostname); one for each address, of equals any."""
    at = lambda i: _finite(t.number(F.get(F.split("loc", ","), F.lit(i))))
    return records.select(
        "ip", F.col("city").alias("geo_city"), F.col("country").alias("geo_country"), at(0).alias("geo_latitude"), at(1).alias("geo_longitude"),
        F.col("hostname").alias("geo_hostname"), t.normal_asn(F.col("org")).alias("geo_asn"), t.without_asn_prefix(F.col("org")).alias("geo_as_name"),
    ).dropDuplicates(["ip"])


def with_status(records: DataFrame) -> DataFrame:
    """ip_geo rows from records (ip, status, country, countryCode, city, lat, lon, as, asname, reverse) that succeeded."""
    text = F.col("as")
    return records.where(F.col("status") == "success").select(
        "ip", F.col("city").alias("geo_city"), F.coalesce("countryCode", "country").alias("geo_country"), _finite(F.col("lat")).alias("geo_latitude"), _finite(F.col("lon")).alias("geo_longitude"),
        F.col("reverse").alias("geo_hostname"), t.normal_asn(text).alias("geo_asn"), F.coalesce(F.col("asname"), t.without_asn_prefix(text)).alias("geo_as_name"),
    ).dropDuplicates(["ip"])
