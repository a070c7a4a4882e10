"""Location fusion: candidates from all evidence of a hop, checked, scored, and the best chosen.

A hop has four candidates at most, each in a column of its own, so everything about them is plain expressions within the row. What
follows from a host name, a geo record or a source's place alone is worked out once for each of those, before hops meet them.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.functions.frames import apart, held, left_joined
from pathloom.operators.hosts import host_matches
from pathloom.sources import dims

CANDIDATE = "struct<source: string, city: string, country: string, lat: double, lon: double, confidence: string, precision: string, cc: string, evidence: array<string>>"
WEAK, STRONG = ("geoip", "provider"), ("reverse_dns", "combined")


def _candidate(source, city, country, lat, lon, confidence, evidence, precision="city", cc=None) -> Column:
    return F.struct(
        F.lit(source).alias("source"), city.alias("city"), country.alias("country"), lat.alias("lat"), lon.alias("lon"),
        F.lit(confidence).alias("confidence"), F.lit(precision).alias("precision"), (geo.country_code(country) if cc is None else cc).alias("cc"), F.array(evidence).alias("evidence"),
    ).cast(CANDIDATE)


def places_of_hosts(names: DataFrame, host: str, out: str, aliases: DataFrame | None = None, cities: DataFrame | None = None) -> DataFrame:
    """(host, out) of the distinct names that an alias of a place matches: struct (city, country, lat, lon, alias) of the first place
    and alias in their tables' order. The tables are the library's own unless given."""
    spark = names.sparkSession
    cities = (dims.cities(spark) if cities is None else cities).select(F.col("ord").alias("__ord"), "city", "country", "latitude", "longitude")
    met = host_matches(names, host, dims.city_aliases(spark) if aliases is None else aliases)
    place = F.struct("city", "country", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("match.alias").alias("alias"))
    return met.join(cities, F.col("match.city_ord") == F.col("__ord")).select(host, place.alias(out))


def matched_hosts(rows: DataFrame, host: str, out: str) -> DataFrame:
    """rows with struct `out` of places_of_hosts for their host name, or null; each distinct name is matched once."""
    return left_joined(rows, held(places_of_hosts(rows, host, out)), F.col(host), host)


def from_host(host: str, match: str) -> Column:
    """A candidate from a host name and its struct of matched_hosts."""
    m = F.col(match)
    said = F.concat(F.lit('reverse DNS matched "'), m["alias"], F.lit('" in '), F.col(host))
    return F.when(m.isNotNull(), _candidate("reverse_dns", m["city"], m["country"], m["lat"], m["lon"], "high", said))


def from_provider(cc: Column | None = None, known_cc: Column | None = None) -> Column:
    """From the hop's own place: with coordinates as given; else its city in the table (struct known), where the country code
    agrees if given. cc and known_cc are the codes of both countries, if they are known."""
    city, country, k = F.col("city"), F.col("country"), F.col("known")
    whole = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.coalesce(city, F.lit("")) != "")
    given = _candidate("provider", city, F.coalesce(country, F.lit("Unknown")), F.col("latitude"), F.col("longitude"), "high", F.lit("provider supplied hop coordinates"), cc=cc)
    agrees = k.isNotNull() & F.coalesce((country == "") | (F.lower(country) == F.lower(k["country"])), F.lit(True))
    return F.when(whole, given).when(agrees, _candidate("provider", k["city"], k["country"], k["lat"], k["lon"], "medium", F.lit("provider supplied hop city/country"), cc=known_cc))


def from_geoip() -> Column:
    whole = F.col("geo_city").isNotNull() & F.col("geo_country").isNotNull() & F.col("geo_latitude").isNotNull() & F.col("geo_longitude").isNotNull()
    return F.when(whole, _candidate("geoip", F.col("geo_city"), F.col("geo_country"), F.col("geo_latitude"), F.col("geo_longitude"), "medium", F.lit("IP GeoIP database match")))


def with_district(c: Column) -> Column:
    """A Hong Kong district becomes Hong Kong."""
    hit = F.coalesce(c["cc"] == "hk", F.lit(False)) & F.coalesce(geo.city_name(c["city"]).isin(dims.HONG_KONG_DISTRICTS), F.lit(False))
    said = F.concat(c["city"], F.lit(" normalized to Hong Kong metro for route readability"))
    hk = dims.CITIES[3]
    moved = F.struct(
        c["source"].alias("source"), F.lit(hk[0]).alias("city"), F.lit(hk[1]).alias("country"), F.lit(hk[2]).alias("lat"), F.lit(hk[3]).alias("lon"),
        c["confidence"].alias("confidence"), F.when(c["precision"] == "exact", "city").otherwise(c["precision"]).alias("precision"), F.lit("hk").alias("cc"), F.array_append(c["evidence"], said).alias("evidence"),
    ).cast(CANDIDATE)
    return F.when(hit, moved).otherwise(c)


def area_of(c: Column) -> Column:
    """The number of a candidate's metropolitan area, or null."""
    return geo.metro_of(c["city"], c["cc"], c["lat"], c["lon"])


def downgraded(c: Column, area: Column, src_metro: Column, rtt: Column) -> Column:
    """Public evidence within the source's own metropolitan area at low latency says no more than the area; area is that of c."""
    label, country, lat, lon, limit = (F.get(F.array(*(F.lit(m[i]) for m in dims.METROS)), src_metro) for i in (1, 2, 3, 4, 6))
    hit = F.coalesce(src_metro.isNotNull() & rtt.isNotNull() & (rtt <= limit) & c["source"].isin(*WEAK) & (src_metro == area), F.lit(False))
    said = F.concat(F.lit("Public geolocation is inside the same low-latency "), label, F.lit("; downgraded to metro-level estimate"))
    moved = F.struct(
        c["source"].alias("source"), label.alias("city"), country.alias("country"), lat.alias("lat"), lon.alias("lon"), F.lit("medium").alias("confidence"),
        F.lit("metro").alias("precision"), F.lower(country).alias("cc"), F.array_append(c["evidence"], said).alias("evidence"),
    ).cast(CANDIDATE)
    return F.when(hit, moved).otherwise(c)


def sane(distance: Column, rtt: Column) -> Column:
    """Whether a distance from the source is plausible at this latency; without source or latency it is."""
    return F.coalesce((rtt <= 0) | (distance <= F.greatest(F.lit(900.0), rtt * 145)), F.lit(True))


def distance(a: Column, b: Column) -> Column:
    return geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"])


def rtt_support(far: Column, rtt: Column) -> Column:
    return F.when(far.isNull() | rtt.isNull() | (rtt <= 0), 0).when((far < 120) & (rtt <= 12), 12).when((far < 900) & (rtt <= 28), 8).when((far < 2800) & (rtt <= 75), 5).otherwise(0)


def base_score(c: Column) -> Column:
    confidence = F.when(c["confidence"] == "high", 30).when(c["confidence"] == "medium", 20).otherwise(10)
    source = F.when(c["source"] == "combined", 18).when(c["source"] == "reverse_dns", 14).when(c["source"] == "provider", 12).otherwise(8)
    return confidence + source


def of_host(names: DataFrame, host: str, match: str, slot: str) -> DataFrame:
    """names (host, match) of places_of_hosts with the slot's candidate."""
    return names.withColumn(slot, with_district(from_host(host, match)))


def of_record(records: DataFrame) -> DataFrame:
    """Geo records with m_geo and what follows from a record alone: c2, c3 and the area of c3."""
    records = left_joined(records, held(places_of_hosts(records, "geo_hostname", "m_geo")), F.col("geo_hostname"), "geo_hostname")
    records = records.withColumns({"c2": with_district(from_host("geo_hostname", "m_geo")), "c3": from_geoip()}).withColumn("c3", F.when(F.col("c3").isNotNull(), with_district(F.col("c3"))))
    return records.withColumn("area_c3", area_of(F.col("c3")))


def looked_up(hops: DataFrame, ip_geo: DataFrame, ptr: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """hops with the geo record of their address and, where they have no host name, the one of the ptr table; with the city hints of
    both host names, m_host and m_geo, each name matched once; and with the candidates that follow from these, c1 to c3.

    Both tables have a row for an address at most; how they are joined depends on their sizes. names has the host names that are
    matched, those of hops unless given.
    """
    if ptr is not None:
        told = ptr.select(F.col("ip").alias("ptr_ip"), F.col("hostname").alias("ptr_hostname"))
        hops = left_joined(hops, told, F.when(hops["hostname"].isNull(), hops["ip"]), "ptr_ip")
        hops = hops.withColumn("hostname", F.coalesce("hostname", "ptr_hostname")).drop("ptr_hostname")
    places = held(of_host(places_of_hosts(hops if names is None else names, "hostname", "m_host"), "hostname", "m_host", "c1"))
    return left_joined(left_joined(hops, places, F.col("hostname"), "hostname"), of_record(ip_geo), F.col("ip"), "ip")


#: The four slots of a hop's candidates, in order, and which of them are weak or strong evidence.
SLOTS = {"c0": "provider", "c1": "reverse_dns", "c2": "reverse_dns", "c3": "geoip"}
WEAK_SLOTS, STRONG_SLOTS = ([c for c, source in SLOTS.items() if source in kind] for kind in (WEAK, STRONG))


#: What looked_up and located_sources add beside the records themselves.
WORKED_OUT = ("m_host", "m_geo", "c1", "c2", "c3", "area_c3", "src_metro")


def located_sources(sources: DataFrame) -> DataFrame:
    """sources (with src_ columns) with the number of their metropolitan area, src_metro; null if none or if the place isn't whole."""
    whole = F.col("src_latitude").isNotNull() & F.col("src_longitude").isNotNull() & F.col("src_city").isNotNull() & F.col("src_country").isNotNull()
    return sources.withColumn("src_metro", F.when(whole, geo.metro_index(F.col("src_city"), F.col("src_country"), F.col("src_latitude"), F.col("src_longitude"))))


def candidates(hops: DataFrame) -> DataFrame:
    """hops (with geo_ and src_ columns) with a column for each slot: the candidate of the hop's own place, of its host name,
    of the geo record's host name and of the geo record, or null, districts moved to their city. What looked_up has not added is
    worked out here.
    """
    for host, out, slot in (("hostname", "m_host", "c1"), ("geo_hostname", "m_geo", "c2")):
        hops = hops if slot in hops.columns or out in hops.columns else matched_hosts(hops, host, out)
        hops = hops if slot in hops.columns else of_host(hops, host, out, slot)
    if "c3" not in hops.columns:
        hops = hops.withColumn("c3", from_geoip()).withColumn("c3", F.when(F.col("c3").isNotNull(), with_district(F.col("c3"))))
    places = dims.cities(hops.sparkSession)
    known = F.struct("city", "country", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    places = F.broadcast(places.select(F.lower("city").alias("__city"), known.alias("known"), geo.country_code(F.col("country")).alias("known_cc")))  # a fixed table of 21 rows
    hops = hops.join(places, F.lower("city") == F.col("__city"), "left").drop("__city")
    hops = hops.withColumn("cc", geo.country_code(F.coalesce("country", F.lit("Unknown"))))
    hops = hops.withColumn("c0", from_provider(F.col("cc"), F.col("known_cc"))).drop("m_host", "m_geo", "known", "known_cc", "cc")
    return hops.withColumn("c0", F.when(F.col("c0").isNotNull(), with_district(F.col("c0"))))


def checked(hops: DataFrame) -> DataFrame:
    """candidates, weak ones moved to the source's area, with a flag kept_ for each slot: it is there, its distance from the source is
    plausible at the latency (sane_), and it lies nowhere else than strong evidence, if it is weak.

    Each distance is worked out once: far_ from the source, and one for each pair of slots.
    """
    hops = hops if "src_metro" in hops.columns else located_sources(hops)
    source = F.when(F.col("src_latitude").isNotNull() & F.col("src_longitude").isNotNull() & F.col("src_city").isNotNull() & F.col("src_country").isNotNull(), F.struct(F.col("src_latitude").alias("lat"), F.col("src_longitude").alias("lon")))
    hops = hops.withColumn("src", apart(source))
    area = {c: F.col(f"area_{c}") if f"area_{c}" in hops.columns else area_of(F.col(c)) for c in WEAK_SLOTS}
    hops = hops.withColumns({c: F.when(F.col(c).isNotNull(), downgraded(F.col(c), area[c], F.col("src_metro"), F.col("rtt_ms"))) for c in WEAK_SLOTS})
    hops = hops.withColumns({f"far_{c}": distance(F.col(c), F.col("src")) for c in SLOTS} | {f"far_{a}{b}": distance(F.col(a), F.col(b)) for a, b in itertools.combinations(SLOTS, 2)})
    hops = hops.withColumns({f"sane_{c}": F.col(c).isNotNull() & apart(sane(F.col(f"far_{c}"), F.col("rtt_ms"))) for c in SLOTS})

    def against(weak: str, strong: str) -> Column:
        far = F.col("far_" + "".join(sorted((weak, strong))))
        return F.coalesce(F.col(f"sane_{strong}") & (far >= 120) & (~F.coalesce(F.col(weak)["cc"] == F.col(strong)["cc"], F.lit(False)) | (far > 320)), F.lit(False))

    conflict = {w: functools.reduce(Column.__or__, (against(w, s) for s in STRONG_SLOTS)) for w in WEAK_SLOTS}
    return hops.withColumns({f"kept_{c}": F.col(f"sane_{c}") & ~conflict[c] if c in conflict else F.col(f"sane_{c}") for c in SLOTS})


def scored(hops: DataFrame) -> DataFrame:
    """checked with score_ for each slot, null where it isn't kept. Kept candidates support each other, also two equal ones."""

    def support(c: str, other: str) -> Column:
        near = F.col("far_" + "".join(sorted((c, other)))) < 90
        return F.when(F.col(f"kept_{other}"), F.when(near, 12).when(F.col(c)["cc"] == F.col(other)["cc"], 4).otherwise(0)).otherwise(0)

    def score(c: str) -> Column:
        total = apart(base_score(F.col(c))) + rtt_support(F.col(f"far_{c}"), F.col("rtt_ms"))
        return F.when(F.col(f"kept_{c}"), functools.reduce(Column.__add__, (support(c, o) for o in SLOTS if o != c), total))

    return hops.withColumns({f"score_{c}": score(c) for c in SLOTS})


def kept(hops: DataFrame) -> Column:
    """Array of (candidate, score) of the slots that are kept, in order."""
    return F.array_compact(F.array(*(F.when(F.col(f"kept_{c}"), F.struct(F.col(c).alias("candidate"), F.col(f"score_{c}").alias("score"))) for c in SLOTS)))


def chosen(hops: DataFrame) -> DataFrame:
    """scored with struct location: combined evidence if host name and geo record agree, else the first of the best scores."""
    rev, gip = F.when(F.col("kept_c1"), F.col("c1")).when(F.col("kept_c2"), F.col("c2")), F.when(F.col("kept_c3"), F.col("c3"))
    hops = hops.withColumns({"rev": rev, "gip": gip, "far_rev": F.when(F.col("kept_c1"), F.col("far_c1c3")).otherwise(F.col("far_c2c3"))})
    rev, gip = F.col("rev"), F.col("gip")
    agree = rev.isNotNull() & gip.isNotNull() & F.coalesce((F.col("far_rev") < 90) | (F.lower(rev["city"]) == F.lower(gip["city"])), F.lit(False))
    combined = F.struct(
        F.lit("combined").alias("source"), rev["city"].alias("city"), rev["country"].alias("country"), rev["lat"].alias("lat"), rev["lon"].alias("lon"),
        F.lit("high").alias("confidence"), rev["precision"].alias("precision"), rev["cc"].alias("cc"), F.concat(rev["evidence"], gip["evidence"]).alias("evidence"),
    ).cast(CANDIDATE)
    most, best = F.greatest(*(f"score_{c}" for c in SLOTS)), F.when(agree, combined)
    for c in SLOTS:
        best = best.when(F.col(f"score_{c}") == most, F.col(c))
    return hops.withColumn("location", apart(best)).drop("rev", "gip", "far_rev")


def enriched(hops: DataFrame) -> DataFrame:
    """hops (with geo_ and src_ columns) with the chosen location in place of their own; without one the own place stays, as
    unknown. Network number and name are the hop's own, else those of its geo record."""
    own = [c for c in hops.columns if c not in WORKED_OUT]
    out = chosen(scored(checked(candidates(hops))))
    l = F.col("location")  # noqa: E741
    has = l.isNotNull()
    new = {
        "asn": F.coalesce("asn", "geo_asn"), "as_name": F.coalesce("as_name", "geo_as_name"),
        "city": F.when(has, l["city"]).otherwise(F.col("city")), "country": F.when(has, l["country"]).otherwise(F.col("country")),
        "latitude": F.when(has, l["lat"]).otherwise(F.col("latitude")), "longitude": F.when(has, l["lon"]).otherwise(F.col("longitude")),
        "location_confidence": F.when(has, l["confidence"]).otherwise("low"), "location_source": F.when(has, l["source"]).otherwise("unknown"),
        "location_precision": F.when(has, l["precision"]).otherwise("unknown"),
        "location_evidence": F.when(has, l["evidence"]).otherwise(F.array(F.lit("No reliable city-level evidence found"))),
    }
    return out.withColumns(new).select(*own, *(c for c in new if c not in own))
