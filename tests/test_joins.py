"""Prefix join, alias index and grid index against plain loops."""

import math
import random
import re
from ipaddress import ip_address, ip_network, summarize_address_range

import pytest
from pyspark.sql import functions as F

from pathloom.operators import areas, hosts, prefixes
from pathloom.plans.queries import QUERIES
from pathloom.sources import dims


def plan(df):
    return df._jdf.queryExecution().toString()


def made_ranges(rng):
    v4 = [f"{ip_address(rng.randrange(1 << 32))}/{rng.choice([0, 1, 8, 15, 24, 31, 32])}" for _ in range(60)]
    v6 = [f"{ip_address(rng.randrange(1 << 128))}/{rng.choice([0, 3, 32, 63, 64, 65, 96, 127, 128])}" for _ in range(60)]
    return [*v4, *v6, "8.8.0.0/16", "8.8.8.0/24", "8.8.8.8", "2001:db8::/32", "2001:db8:1::/48", "::1", "::ffff:1.2.3.0/120"]


def test_prefixes_against_plain_loops(spark):
    rng = random.Random(1)
    cidrs = made_ranges(rng)
    ips = [str(ip_address(rng.randrange(1 << 32))) for _ in range(80)] + [str(ip_address(rng.randrange(1 << 128))) for _ in range(80)]
    ips += [str(ip_network(c, strict=False)[n]) for c in cidrs for n in (0, -1)] + ["8.8.8.8", "8.8.8.9", "8.8.9.1", "2001:DB8:1::5", "::1", "::ffff:1.2.3.4", "256.1.1.1", "x", "", None]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ips)], "ip string, cidr int").repartition(4)
    bad = ["1.2.3.4/33", "::/129", "1.2.3/8", "1.2.3.4/x", "1.2.3.4/", None]
    table = prefixes.cidr_prefixes(spark.createDataFrame([(c,) for c in cidrs + bad], "range string"), "range")
    nets = {c: ip_network(c, strict=False) for c in cidrs}

    def holding(ip):
        try:
            a = ip_address(ip)
        except ValueError:
            return set()
        return {c for c, n in nets.items() if a.version == n.version and a in n}

    got = prefixes.prefix_matches(df, "ip", table)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    found = {}
    for r in got.collect():
        found.setdefault(r.ip, set()).add(r.range)
    assert found == {x: holding(x) for x in ips if x and holding(x)}
    for r in prefixes.longest_prefix(df, "ip", table).collect():
        all_ = holding(r.ip) if r.ip else set()
        most = max((nets[c].prefixlen for c in all_), default=None)
        assert r.range == min((c for c in all_ if nets[c].prefixlen == most), default=None)
    short = spark.createDataFrame([("8.8.0.0/16",), ("2001:db8::/32",)], "cidr string")
    away = {r.ip for r in prefixes.outside(df, "ip", prefixes.cidr_prefixes(short)).collect()}
    assert "8.8.9.1" not in away and "2001:DB8:1::5" not in away and "::1" in away and "x" not in away
    assert prefixes.longest_prefix(df, "ip", table.limit(0)).where("range is not null").count() == 0
    assert prefixes.prefix_matches(df.limit(0), "ip", table).count() == 0


def test_spans_as_prefixes(spark):
    rng = random.Random(2)
    spans = [(0, (1 << 32) - 1), (0, 0), (1, (1 << 32) - 2), (5, 4), (7, 7)] + [tuple(sorted(rng.randrange(1 << rng.choice([4, 20, 32])) for _ in range(2))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, low long, high long")
    got = {}
    for r in prefixes.span_prefixes(df).collect():
        got.setdefault(r.i, set()).add(((r.hi >> 32) & 0xFFFFFFFF, r.bits))
    for i, (a, b) in enumerate(spans):
        want = {(int(n.network_address), n.prefixlen) for n in summarize_address_range(ip_address(a), ip_address(b))} if a <= b else set()
        assert got.get(i, set()) == want, (a, b)


def first_alias(host, aliases):
    tokens = [re.sub(r"^[0-9]+|[0-9]+$", "", x) for x in re.split(r"[._()\s-]", host.lower())]
    flat = re.sub(r"\s", "", host.lower())
    for place, number, a in aliases:
        for form in {a, a.replace("-", "")} - {""}:
            if form in tokens or len(a) >= 4 and any(x.endswith(form) for x in tokens) or len(a) >= 5 and form in flat:
                return place, number, a
    return None


def test_alias_index_against_plain_loops(spark):
    rng = random.Random(3)
    own = [(i, j, a) for i, c in enumerate(dims.CITIES) for j, a in enumerate(c[4])]
    many = sorted({(rng.randrange(3000), rng.randrange(9), "".join(rng.choices("abcdefgh-", k=rng.randint(1, 9))).strip("-")) for _ in range(10_000)} - {(0, 0, "")})
    many = [x for x in many if x[2] and x[2].replace("-", "")]
    for aliases, letters in ((own, "abcdefghijklmnopqrstuvwxyz0123456789.-_ "), (many, "abcdefghij01.-_ ")):
        names = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(150)]
        names += [f"{rng.choice('x0.-')}{rng.choice(aliases)[2]}{rng.choice(['', '1', '.net', 'q'])}" for _ in range(150)] + ["", "ae1.ICN9.example", "ksyd-1", "xsyd", "Los Angeles.pop", "new-york", "newyork1"]
        df = spark.createDataFrame([(n,) for n in [*names, names[3], None]], "host string").repartition(3)
        table = spark.createDataFrame(aliases, "city_ord int, alias_ord int, alias string")
        met = hosts.host_matches(df, "host", table)
        assert "NestedLoop" not in plan(met) and "Cartesian" not in plan(met)
        ordered = sorted(aliases)
        want = {n: m for n in names if (m := first_alias(n, ordered))}
        assert {r.host: tuple(r.match) for r in met.collect()} == want
    assert hosts.host_matches(df, "host", table.limit(0)).count() == 0


def test_areas_against_plain_loops(spark):
    rng = random.Random(4)
    circles = [(i, f"a{i}", rng.choice(["xx", "yy"]), rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice([0.0, 5.0, 80.0, 900.0])) for i in range(150)]
    circles += [(200, "north", "xx", 89.9, 10.0, 300.0), (201, "south", "xx", -90.0, 0.0, 250.0), (202, "line", "yy", 0.0, 179.9, 200.0), (203, "all", "zz", 0.0, 0.0, 20_100.0), (204, "half", "zy", 45.0, -180.0, 9000.0)]
    listed = [("a3", "town"), ("a5", "town"), ("north", "pole")]
    places = [(rng.choice(["town", "pole", None, "x"]), rng.choice(["xx", "yy", "zz", "zy", None]), rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(400)]
    places += [(None, c[2], c[3] + d, c[4]) for c in circles for d in (0.0, 0.5) if c[3] + d <= 90] + [("x", "xx", 90.0, -77.0), ("x", "yy", 0.1, -179.5), ("x", "yy", 0.0, 180.0), ("town", "xx", None, None), ("x", "xx", 85.0, -170.0)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(x))

    def first(p):
        for o, area, cc, lat, lon, r in circles:
            if cc == p[1] and ((area, p[0]) in listed or p[2] is not None and km(p[2], p[3], lat, lon) <= r):
                return o, area
        return None

    df = spark.createDataFrame(places, "name string, cc string, latitude double, longitude double")
    table = spark.createDataFrame(circles, "ord int, area string, cc string, latitude double, longitude double, radius_km double")
    got = areas.area_matches(df, table, spark.createDataFrame(listed, "area string, name string"))
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert {tuple(r)[:4]: (r.ord, r.area) for r in got.collect()} == {p: first(p) for p in places if first(p)}
    assert got.select(F.max(F.col("ord"))).first()[0] >= 203


def test_rows_without_a_key_are_dealt_out(spark):
    from pathloom.functions.frames import left_joined

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        rows = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("k"), F.col("id"))).alias("key"))
        found = spark.createDataFrame([("k100", 1), ("k200", 2), ("", 3), ("0", 4), (None, 5)], "name string, n int")
        out = left_joined(rows, found, F.col("key"), "name")
        assert out.columns == ["id", "key", "n"] and {(r.id, r.n) for r in out.where("n is not null").collect()} == {(100, 1), (200, 2)}
        parts = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 4000 and max(parts) < 1600
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_predicates_stay_above_what_is_worked_out_once(spark):
    from pathloom.functions.frames import worked_out

    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "x string").distinct()
    out = worked_out(rows, {"y": F.sha2("x", 256)}).where("y <> 'z' and length(y) > 3")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2") == 1 and out.count() == 2


def test_hops_of_islands_are_read_and_dealt_out_once(spark, capsys):
    """Both ends, segments and groups of a measurement come from one scan and one exchange of its lines; hops are counted, not listed."""
    QUERIES["place_islands"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == 3 and "collect_list" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\((?:l_orderkey|measurement_id)", plan)) == 2


@pytest.mark.parametrize("name", ["candidate_scores", "enriched_hops"])
def test_hops_stay_where_they_are_for_lookups(spark, capsys, name):
    """Hops are dealt out by measurement alone: lookup tables come to them, as sources do. Of the exchanges, one is that of the lines and
    three are those of orders and customers."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 4 and "Exchange SinglePartition" not in plan


def test_lookup_tables_too_large_to_send(spark, monkeypatch):
    """Where no table is small, both sides move, with the same rows."""
    from pathloom.functions import frames

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id int, key string")
    found = spark.createDataFrame([("a", 1.5), ("c", None), (None, 2.0)], "name string, n double")
    joined = lambda: frames.left_joined(rows, found, F.col("key"), "name")
    few, want = joined(), {(1, "a", 1.5), (2, "b", None), (3, None, None), (4, "c", None)}
    assert "Broadcast" in few._jdf.queryExecution().executedPlan().toString()
    score = lambda: sorted(map(tuple, QUERIES["candidate_scores"](spark, "/root/testdata/sf0.001").collect()))
    scores = score()
    monkeypatch.setattr(frames, "SENT", -1)
    assert "__on" in plan(joined()) and {tuple(r) for r in few.collect()} == {tuple(r) for r in joined().collect()} == want
    assert score() == scores
