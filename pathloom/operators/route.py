"""Routes: hops to segments by network and place, and to points on a map.

All windows of a measurement share one partitioning, so it is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.functions import text as t
from pathloom.sources import dims

M = "measurement_id"
MOST_POINTS = 12
RANKS = {"pending": 0, "ok": 1, "slow": 2, "loss": 3, "timeout": 4}


def rank(status: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv)), status)


def network(asn: Column, field: int) -> Column:
    """Name (1) or country (2) of a known network."""
    return F.try_element_at(F.create_map(*(F.lit(x) for n in dims.NETWORKS for x in (n[0], n[field]))), asn)


def place_key(city: Column, country: Column) -> Column:
    return F.concat(F.lower(city), F.lit(":"), F.lower(country))


def placed(hops: DataFrame) -> DataFrame:
    """hops with the shown place: place_city, place_country, place; null without coordinates."""
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    city = F.coalesce(t.or_null(F.col("city")), t.or_null(F.col("hostname")), t.or_null(F.col("ip")), F.lit("Network"))
    country = F.coalesce(t.or_null(geo.country_label(F.col("country"))), t.or_null(F.col("country")), F.lit("Unknown"))
    out = hops.withColumns({"place_city": F.when(has, city), "place_country": F.when(has, country)})
    return out.withColumns({"place": place_key(F.col("place_city"), F.col("place_country")), "asn": F.coalesce(t.or_null(F.col("asn")), F.lit("AS???"))})


def islands(rows: DataFrame, key: Column, order: str, name: str) -> DataFrame:
    """rows with column name: the number of the run of equal keys that a row is in, by measurement, from 1."""
    w = Window.partitionBy(M).orderBy(order)
    new = F.when(key.eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn(name + "_new", new).withColumn(name, F.sum(name + "_new").over(w).cast("int")).drop(name + "_new")


HOP = "struct<hop_seq: int, hop_number: int, asn: string, name: string, rtt_ms: double, packet_loss_percent: double, status: string>"


def segments(hops: DataFrame, *more: str) -> DataFrame:
    """Runs of hops of one network at one place: a row each with its hops, their number and its worst status. The columns `more` are
    taken along from the first hop."""
    rows = placed(hops)
    key = F.concat_ws(":", "asn", F.coalesce("place", network(F.col("asn"), 2), F.lit("unknown")))
    rows = islands(rows, key, "hop_seq", "segment").withColumn("name", F.coalesce(network(F.col("asn"), 1), F.col("as_name")))
    hop = F.struct("hop_seq", "hop_number", "asn", "name", "rtt_ms", "packet_loss_percent", "status").cast(HOP)
    first = lambda c: F.min_by(c, "hop_seq").alias(c)
    return rows.groupBy(M, "segment").agg(
        *(first(c) for c in ("asn", "name", "place", "place_city", "place_country", "latitude", "longitude", *more)),
        F.array_sort(F.collect_list(hop)).alias("hops"), F.count("*").cast("int").alias("n_hops"), F.max_by("status", rank(F.col("status"))).alias("status"),
    )


def starts(sources: DataFrame) -> DataFrame:
    """(measurement_id, src_…): the source by its coordinates or its country's centre."""
    lat, lon = geo.centroid(F.col("src_country"))
    both = F.col("src_latitude").isNotNull() & F.col("src_longitude").isNotNull()
    label = t.or_null(geo.country_label(F.col("src_country")))
    return sources.select(
        M, F.coalesce(t.or_null(F.col("src_city")), F.lit("Nearby probe")).alias("src_city"), F.coalesce(label, t.or_null(F.col("src_country")), F.lit("Probe")).alias("src_country"),
        F.when(both, F.col("src_latitude")).otherwise(lat).alias("src_lat"), F.when(both, F.col("src_longitude")).otherwise(lon).alias("src_lon"),
    )


def endpoints(hops: DataFrame, sources: DataFrame) -> DataFrame:
    """(measurement_id, src_…, dst_…): the source as of starts(), the target by the last placed hop."""
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    dst = hops.where(has).groupBy(M).agg(F.max_by("latitude", "hop_seq").alias("dst_lat"), F.max_by("longitude", "hop_seq").alias("dst_lon"))
    return starts(sources).join(dst, M, "left")


def transit(hops: DataFrame, sources: DataFrame) -> DataFrame:
    """Segments that are shown: known network and place, not at either end, neighbours at one place as one.

    The target is found among the measurement's own hops where they are, so hops are read and dealt out once.
    """
    at = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.col("hop_seq"))
    last = lambda c: F.max_by(c, at).over(Window.partitionBy(M))
    hops = hops.withColumns({"dst_lat": last("latitude"), "dst_lon": last("longitude")})
    seg = segments(hops, "dst_lat", "dst_lon").where((F.col("asn") != "AS???") & F.col("place").isNotNull()).join(starts(sources), M)
    at_end = lambda e: F.coalesce(geo.near_on_map(F.col("latitude"), F.col("longitude"), F.col(f"{e}_lat"), F.col(f"{e}_lon")), F.lit(False))
    seg = islands(seg.where(~at_end("src") & ~at_end("dst")), F.col("place"), "segment", "group")
    first = lambda c: F.min_by(c, "segment").alias(c)
    return seg.groupBy(M, "group").agg(
        *(first(c) for c in ("asn", "name", "place", "place_city", "place_country", "latitude", "longitude")),
        F.array_sort(F.flatten(F.collect_list("hops"))).alias("hops"), F.sum("n_hops").cast("int").alias("n_hops"), F.max_by("status", rank(F.col("status"))).alias("status"),
    )


def sampled(groups: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """At most `most` groups of each measurement, evenly spaced, first and last among them."""
    n = F.count("*").over(Window.partitionBy(M))
    at = F.sequence(F.lit(0), F.lit(most - 1))
    wanted = F.transform(at, lambda i: F.round(i / F.lit(most - 1) * (F.col("n_groups") - 1)).cast("int") + 1)
    out = groups.withColumn("n_groups", n)
    return out.where((F.col("n_groups") <= most) | F.array_contains(wanted, F.col("group"))).drop("n_groups")


def hop_ranges(numbers: Column) -> Column:
    """The label of an array of hop numbers: ranges of those above 0, as in "Mapped hops 1-3, 5"; null if there are none."""
    n = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x > 0)))
    starts = lambda n: F.filter(n, lambda x: ~F.array_contains(n, x - 1))
    ends = lambda n: F.filter(n, lambda x: ~F.array_contains(n, x + 1))
    text = F.array_join(F.transform(F.arrays_zip(starts(n).alias("a"), ends(n).alias("b")), lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"], r["b"]))), ", ")
    return F.when(F.size(n) > 1, F.concat(F.lit("Mapped hops "), text)).when(F.size(n) == 1, F.concat(F.lit("Mapped hop "), text))


def listed(values: Column, more: str, otherwise: Column) -> Column:
    """One or two distinct values, else the first and how many more."""
    v = F.array_distinct(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""))
    many = F.concat(F.get(v, F.lit(0)), F.lit(" +"), (F.size(v) - 1).cast("string"), F.lit(more))
    return F.when(F.size(v) == 0, otherwise).when(F.size(v) <= 2, F.array_join(v, " / ")).otherwise(many)


def loss_label(loss: Column) -> Column:
    """A percentage with a decimal only where it has one; the binary value is rounded, and its exact ties go up."""
    # From 1/16 on, 2^56 times the fraction is whole. Below, 0.1 begins at the double next to 0.05, which is above it.
    tenths = F.shiftright(((loss - F.floor(loss)) * float(1 << 56)).cast("long") * 10 + (1 << 55), 56)
    tenths = F.floor(loss) * 10 + F.when(loss >= 0.0625, tenths).otherwise((loss >= 0.05).cast("long"))
    exact = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.concat(F.when(loss % 1 == 0, loss.cast("long").cast("string")).otherwise(exact), F.lit("%"))


def metric_label(rtt: Column, loss: Column, status: Column) -> Column:
    """Latency, loss above 0 and status unless ok; null if nothing is left."""
    parts = [F.concat(F.round(rtt).cast("long").cast("string"), F.lit(" ms avg")), F.when(loss > 0, F.concat(loss_label(loss), F.lit(" loss"))), F.when(status != "ok", status)]
    return t.or_null(F.concat_ws(" · ", *parts))


def location_label(city: Column, country: Column) -> Column:
    c, k = t.or_null(t.trimmed(city)), t.or_null(t.trimmed(country))
    both = (F.lower(c) != F.lower(k)) & (F.lower(k) != "unknown")
    return F.when(both, F.concat_ws(", ", c, k)).otherwise(F.coalesce(c, k, F.lit("Estimated network region")))


def labelled(groups: DataFrame) -> DataFrame:
    """Groups with label, sub_label and hop_count."""
    hops, last = F.col("hops"), F.element_at("hops", -1)
    asn = listed(F.filter(F.transform(hops, lambda h: h["asn"]), lambda a: a != "AS???"), " AS", F.col("asn"))
    name = listed(F.transform(hops, lambda h: h["name"]), " networks", F.coalesce(t.or_null(F.col("name")), F.lit("Unknown network")))
    n = F.size(hops)
    counted = F.when(n > 1, F.concat(n.cast("string"), F.lit(" hops")))
    return groups.withColumns({
        "hop_count": n, "label": F.concat_ws(" · ", asn, name, location_label(F.col("place_city"), F.col("place_country"))),
        "sub_label": t.joined(" · ", hop_ranges(F.transform(hops, lambda h: h["hop_number"])), counted, metric_label(last["rtt_ms"], last["packet_loss_percent"], last["status"])),
    })


POINT = "struct<ord: int, latitude: double, longitude: double, label: string, sub_label: string, hop_count: int, status: string>"


def merged_points(points: Column) -> Column:
    """A fold in order: a point near the first point of an earlier cluster joins it, else it starts its own. Not transitive."""
    empty = F.expr(f"cast(array() as array<{POINT}>)")

    def step(acc: Column, p: Column) -> Column:
        near = lambda c: geo.near_on_map(c["latitude"], c["longitude"], p["latitude"], p["longitude"])
        at = F.array_position(F.transform(acc, near), True)

        def joined(c: Column, i: Column) -> Column:
            stronger = F.when(rank(p["status"]) > rank(c["status"]), p["status"]).otherwise(c["status"])
            both = F.struct(c["ord"], c["latitude"], c["longitude"], c["label"], t.joined(" · ", c["sub_label"], p["sub_label"]), (c["hop_count"] + p["hop_count"]), stronger).cast(POINT)
            return F.when(i + 1 == at, both).otherwise(c)

        return F.when(at > 0, F.transform(acc, joined)).otherwise(F.array_append(acc, p)).cast(f"array<{POINT}>")

    return F.aggregate(points, empty, step)


def route_points(hops: DataFrame, sources: DataFrame, target: Column | None = None) -> DataFrame:
    """(measurement_id, sequence, role, latitude, longitude, label, sub_label, hop_count, status): source, transit, target."""
    groups = labelled(sampled(transit(hops, sources)))
    point = F.struct(F.col("group").alias("ord"), "latitude", "longitude", "label", "sub_label", F.col("hop_count").cast("int"), "status").cast(POINT)
    by = groups.groupBy(M).agg(merged_points(F.array_sort(F.collect_list(point))).alias("points"))
    all_ = endpoints(hops, sources).join(by, M, "left")
    ends = F.when(F.col("src_country").isin("Probe", "Target"), F.col("src_city")).otherwise(F.concat_ws(" ", "src_city", "src_country"))
    row = lambda role, o, lat, lon, label, sub, n, status: F.struct(F.lit(role).alias("role"), o.alias("ord"), lat.alias("latitude"), lon.alias("longitude"), label.alias("label"), sub.alias("sub_label"), n.alias("hop_count"), status.alias("status"))
    none, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    src = row("source", F.lit(0), F.col("src_lat"), F.col("src_lon"), ends, none, number, F.lit("source"))
    mid = F.transform(F.coalesce("points", F.expr(f"cast(array() as array<{POINT}>)")), lambda p: row("transit", p["ord"], p["latitude"], p["longitude"], p["label"], p["sub_label"], p["hop_count"], p["status"]))
    dst = row("target", F.lit(1 << 30), F.col("dst_lat"), F.col("dst_lon"), target if target is not None else F.col(M), none, number, F.lit("target"))
    whole = F.concat(F.array(src), mid, F.when(F.col("dst_lat").isNotNull(), F.array(dst)).otherwise(F.slice(F.array(dst), 1, 0)))
    out = all_.select(M, F.posexplode(whole).alias("i", "p"))
    return out.select(M, (F.col("i") + 1).alias("sequence"), *(F.col(f"p.{c}").alias(c) for c in ("role", "latitude")), geo.wrapped(F.col("p.longitude")).alias("longitude"), *(F.col(f"p.{c}").alias(c) for c in ("label", "sub_label", "hop_count", "status")))


def marker_color(status: Column) -> Column:
    return F.when(status.isin("loss", "timeout"), "#ff756c").when(status == "slow", "#f6c65b").when(status == "target", "#8f88ff").otherwise("#5ee7ff")


def role_label(role: Column) -> Column:
    return F.when(role == "source", "SRC").when(role == "target", "DST")


def source_label(city: Column, country: Column) -> Column:
    """Where a measurement's probe is, for the badge."""
    return F.coalesce(t.or_null(t.joined(", ", city, geo.country_label(country))), F.lit("Nearby probe"))


def view_keys(points: DataFrame) -> DataFrame:
    """(measurement_id, view_key): what a drawn route depends on, as text: role, coordinates to four places, label."""
    place = lambda c: F.round(c, 4).cast("decimal(10,4)").cast("string")
    part = F.concat("role", F.lit(":"), place("latitude"), F.lit(","), place("longitude"), F.lit(":"), F.coalesce("label", F.lit("undefined")))
    return points.groupBy(M).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", part.alias("part")))), lambda x: x["part"]), "|").alias("view_key"))
