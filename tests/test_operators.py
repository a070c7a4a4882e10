import json

from pyspark.sql import functions as F

from pathloom.operators import decode, fusion, report, route, summary
from pathloom.sources import synthetic

GEO = "geo_city string, geo_country string, geo_latitude double, geo_longitude double, geo_hostname string, geo_asn string, geo_as_name string"
SRC = "src_city string, src_country string, src_latitude double, src_longitude double"
SEOUL, TOKYO, FRANKFURT = ("Seoul", "KR", 37.57, 126.98), ("Tokyo", "JP", 35.6762, 139.6503), ("Frankfurt", "DE", 50.1109, 8.6821)
NONE = (None,) * 4


def raw(spark, *lines):
    df = spark.createDataFrame([("m", "\n".join(lines))], "measurement_id string, raw string")
    return {r.line_no: r for r in decode.raw_hops(decode.raw_lines(df)).collect()}


def test_raw_text(spark):
    got = raw(
        spark, "1 AS15169 edge.google.com 142.250.206.14 20.2 ms 22.7 ms 21.1 ms", "2 * * *", "1 AS13335 one.one.one.one 1.1.1.1 0.0% 0 16 14.6 15.2 0.7",
        "1 edge.local 10.0.0.1 1.0 ms", "1 edge.local 100.64.0.1 1.0 ms", "1 host 8.8.8.8 10 ms * 12 ms", "abc", "  ", "3) x (waiting for reply)",
    )
    a = got[0]
    assert (a.hop_number, a.asn, a.hostname, a.ip, a.rtt_ms, a.status) == (1, "AS15169", "edge.google.com", "142.250.206.14", 21.0, "ok")
    assert (got[1].packet_loss_percent, got[1].status, got[1].hostname) == (100.0, "loss", None)
    b = got[2]
    assert (b.packet_loss_percent, b.sent, b.rtt_ms, b.jitter_ms, b.status) == (0.0, 16, 15.0, 1.0, "ok")
    assert got[3].asn == got[4].asn == "AS???"
    assert (got[5].rtt_ms, got[5].packet_loss_percent, got[5].status) == (11.0, 100.0, "loss")
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 8] and got[8].hostname is None


def test_json_shapes(spark):
    one = {"hops": [{"resolvedAddress": "1.1.1.1", "stats": {"avg": 14.4, "loss": 0, "jAvg": 1.6, "sent": 16, "min": 12.2, "max": 18.7}, "location": {"city": "Sydney", "country": "AU"}, "network": {"asn": 13335, "name": "Cloudflare"}}]}
    two = {"hops": [], "result": [{"hop": 3, "ip": "203.0.113.7", "packetLoss": 75, "rtt": "12", "sent": ""}]}
    three = {"hops": [{"asn": "AS???"}, {"network": {"number": "15169"}}, {"as": {"id": {"value": "13335"}}}, {"timings": [{"rtt": 10}, {"rtt": 13.1}]}]}
    four = {"result": {"rawOutput": "1 a.b 8.8.8.8 5 ms\nx"}}
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate((one, two, three, four, {}, [1]))], "m int, payload string")
    df = df.union(spark.createDataFrame([(9, "not json"), (10, None)], "m int, payload string"))
    got = {(r.m, r.hop_seq): r for r in decode.json_hops(df).collect()}
    a = got[0, 1]
    assert (a.asn, a.as_name, a.rtt_ms, a.jitter_ms, a.best_ms, a.worst_ms, a.sent, a.city, a.status) == ("AS13335", "Cloudflare", 14.0, 2.0, 12.2, 18.7, 16, "Sydney", "ok")
    assert (got[1, 1].hop_number, got[1, 1].packet_loss_percent, got[1, 1].rtt_ms, got[1, 1].sent, got[1, 1].status) == (3, 75.0, None, 0, "loss")
    assert [got[2, i].asn for i in (1, 2, 3)] == ["AS???", "AS15169", "AS13335"] and got[2, 4].rtt_ms == 12.0
    assert (got[3, 1].ip, got[3, 1].rtt_ms) == ("8.8.8.8", 5.0)
    assert sorted({k for k, _ in got}) == [0, 1, 2, 3]
    said = spark.createDataFrame([('{"status":"failed","error":" no "}',), ('{"status":"failed"}',), ('{"status":"ok","error":"x"}',)], "payload string")
    assert [r.failure for r in decode.failure_message(said).collect()] == ["no", decode.FAILED, None]


def test_json_keys_and_levels(spark):
    hops = [
        {"asNumber": 7, "owner": "O", "resolvedCity": "C", "resolvedCountry": "X", "lon": 5, "lng": 7},
        {"autonomousSystem": "AS12 x", "geo": {"name": "N", "country_code": "NC"}, "stats": {"jitterAvg": "1.5"}},
        {"location": {"country": "LC"}, "geo": {"city": "never"}, "autonomousSystem": {"id": 9, "description": "D"}},
        {"asn": 0, "as": -3, "resolvedASN": 64500.9, "location": 3, "geoip": {"lat": "1.25", "lng": "2%"}},
        {"asn": " as??? ", "networkName": " ", "autonomousSystemName": " S "},
        {"as": {"number": {"value": "AS 77"}}, "network": {"owner": "W"}}, 5, {"asn": {"asn": None, "number": "x", "id": 4}},
    ]
    df = spark.createDataFrame([(json.dumps({"hops": hops}),)], "payload string")
    got = {r.hop_seq: r for r in decode.json_hops(df).collect()}
    assert [got[i].asn for i in range(1, 9)] == ["AS7", "AS12", "AS9", "AS64500", "AS???", "AS77", None, None]
    assert [got[i].as_name for i in range(1, 7)] == ["O", None, "D", None, "S", "W"]
    assert [(got[i].city, got[i].country) for i in range(1, 4)] == [("C", "X"), ("N", "NC"), (None, "LC")]
    assert (got[1].longitude, got[2].jitter_ms, got[4].latitude, got[4].longitude, got[7].status) == (5.0, 1.5, 1.25, 2.0, "timeout")


def test_sources_and_applied_results(spark):
    payload = json.dumps({"probe": {"id": "p", "city": "Seoul", "country": "KR", "asn": 4766, "latitude": 37.5, "longitude": "127"}, "result": {"hops": [{"ip": "1.1.1.1"}]}})
    results = spark.createDataFrame([("a", payload)], "measurement_id string, payload string")
    s = decode.json_sources(results).first().source
    assert (s.provider, s.probe_id, s.city, s.asn, s.latitude, s.longitude, s.note) == ("globalping", "p", "Seoul", "AS4766", 37.5, None, decode.NOTE)
    out = decode.applied(spark.createDataFrame([("a", "x"), ("b", "y")], "measurement_id string, target string"), results, decode.json_hops(results), spark.createDataFrame([("a", "high")], "measurement_id string, confidence string"))
    got = {r.measurement_id: r for r in out.collect()}
    assert got["a"].source.city == "Seoul" and [h.ip for h in got["a"].hops] == ["1.1.1.1"] and got["a"].confidence == "high" and got["b"].source is None and got["b"].target == "y"


def fuse(spark, host, rtt, own, geo, src):
    df = spark.createDataFrame([("m", 1, None, None, host, rtt, *own, *geo, None, "AS15169", "Google", *src)], f"measurement_id string, hop_seq int, asn string, as_name string, hostname string, rtt_ms double, city string, country string, latitude double, longitude double, {GEO}, {SRC}")
    return fusion.enriched(df).first()


def test_fusion(spark):
    r = fuse(spark, "edge.example.net", 22.0, SEOUL, TOKYO, NONE)
    assert (r.city, r.country, r.location_confidence, r.location_source) == ("Seoul", "KR", "high", "provider") and (r.asn, r.as_name) == ("AS15169", "Google")
    r = fuse(spark, "nrt-edge.example.net", 18.0, NONE, TOKYO, NONE)
    assert (r.city, r.location_confidence, r.location_source) == ("Tokyo", "high", "combined") and len(r.location_evidence) == 2
    r = fuse(spark, None, 8.0, SEOUL, TOKYO, SEOUL)
    assert (r.city, r.location_source, r.location_precision, r.location_confidence) == ("Seoul metro", "provider", "metro", "medium")
    assert fuse(spark, None, 20.0, TOKYO, FRANKFURT, SEOUL).city == "Tokyo"
    r = fuse(spark, None, 5.0, NONE, NONE, NONE)
    assert (r.location_confidence, r.location_source, r.location_precision, r.location_evidence) == ("low", "unknown", "unknown", ["No reliable city-level evidence found"])
    r = fuse(spark, None, None, ("Wan Chai", "HK", 22.28, 114.17), NONE, NONE)
    assert r.city == "Hong Kong" and r.location_evidence[-1].startswith("Wan Chai normalized")
    # Weak evidence far from a host name's city goes.
    assert fuse(spark, "fra1.example.net", None, TOKYO, NONE, NONE).city == "Frankfurt"
    # The country is compared as given here.
    assert fuse(spark, None, None, ("Seoul", "South Korea", None, None), NONE, NONE).location_source == "unknown"


def test_host_cities(spark):
    df = spark.createDataFrame([("ae1.iad2.net",), ("xe-0.losangeles-core.net",), ("mysel.net",), ("hongkonggate.x",), ("KSYD7.x",), (None,)], "h string")
    found = {r.h: r.city for r in fusion.matched_hosts(df, "h", "m").select("h", "m.city").collect()}
    assert [found[r.h] for r in df.collect()] == ["Ashburn", "Los Angeles", None, "Hong Kong", "Sydney", None]


def test_confidence(spark):
    rows = [("a", 1.0, 1.0, "high"), ("a", 1.0, 1.0, "high"), ("b", None, None, "low"), ("d", 1.0, 1.0, "medium"), *[("c", 1.0, 1.0, "medium")], *[("c", None, None, "low")] * 4]
    df = spark.createDataFrame(rows, "measurement_id string, latitude double, longitude double, location_confidence string")
    assert {r.measurement_id: r.confidence for r in summary.confidence(df).collect()} == {"a": "high", "b": "low", "c": "low", "d": "medium"}


HOPS = "measurement_id string, hop_seq int, hop_number int, asn string, as_name string, ip string, hostname string, city string, country string, latitude double, longitude double, rtt_ms double, packet_loss_percent double, status string"


def hops(spark, *rows):
    """Hops (asn, city, lat, lon) of measurement m."""
    return spark.createDataFrame([("m", i + 1, i + 1, a, None, None, None, c, "XX", lat, lon, 10.0, 0.0, "ok" if i % 2 else "slow") for i, (a, c, lat, lon) in enumerate(rows)], HOPS)


def sources(spark):
    return spark.createDataFrame([("m", "Start", "KR", -80.0, 0.0)], f"measurement_id string, {SRC}")


def test_segments_and_merging(spark):
    h = hops(spark, ("A", "x", 1.0, 1.0), ("A", "x", 1.0, 1.0), ("B", "x", 1.0, 1.0), ("A", "x", 1.0, 1.0), ("C", "end", 70.0, 70.0))
    assert route.segments(h).where("latitude = 1").count() == 3
    t = route.transit(h, sources(spark)).collect()
    assert [(r.asn, len(r.hops), r.status) for r in t] == [("A", 4, "slow")]
    gap = hops(spark, ("A", "x", 1.0, 1.0), ("AS???", "y", 2.0, 9.0), ("A", "x", 1.0, 1.0), ("C", "end", 70.0, 70.0))
    assert route.segments(gap).where("latitude < 50").count() == 3 and [len(r.hops) for r in route.transit(gap, sources(spark)).collect()] == [2]


def test_sampling_is_even(spark):
    groups = spark.range(1, 21).select(F.lit("m").alias("measurement_id"), F.col("id").cast("int").alias("group"))
    assert sorted(r.group - 1 for r in route.sampled(groups).collect()) == [0, 2, 3, 5, 7, 9, 10, 12, 14, 16, 17, 19]


def test_points(spark):
    h = hops(spark, ("A", "p", 5.0, 10.0), ("B", "q", 5.0, 10.5), ("C", "r", 5.0, 11.0), ("D", "end", 70.0, 190.0))
    got = route.route_points(h, sources(spark), F.lit("example.com")).orderBy("sequence").collect()
    assert [(r.sequence, r.role, r.hop_count, r.longitude) for r in got] == [(1, "source", None, 0.0), (2, "transit", 2, 10.0), (3, "transit", 1, 11.0), (4, "target", None, -170.0)]
    assert got[1].status == "slow" and got[1].label.startswith("A · Unknown network · p, XX") and got[3].label == "example.com"
    assert got[1].sub_label == "Mapped hop 1 · 10 ms avg · slow · Mapped hop 2 · 10 ms avg"
    assert route.view_keys(route.route_points(h, sources(spark))).first().view_key.startswith(f"source:-80.0000,0.0000:{got[0].label}|transit:")


def test_reports(spark):
    h = hops(spark, ("A", "x", 1.0, 1.0)).withColumn("rtt_ms", F.lit(15.0)).withColumn("packet_loss_percent", F.lit(None).cast("double"))
    r = report.mtr_rows(h).first()
    assert (r.snt, r["last"], r.avg, r.best, r.wrst, r.stdev, r.loss) == ("16", "15", "15", "15", "15", "0", "-")
    assert report.hop_detail(h.withColumn("rtt_ms", F.lit(0.0))).first().rtt == "-"
    m = spark.createDataFrame([("finished", 2), ("finished", 0), ("running", 3)], "status string, n_hops int")
    assert report.finished(m).count() == 1


def test_synthetic_source(spark):
    req = spark.createDataFrame([("a", "1.1.1.1", "mtr"), ("b", "google.com", "traceout"), ("c", "example.com", "mtr")], "measurement_id string, target string, mode string")
    h = synthetic.hops(req)
    assert {r.measurement_id: r.rtt_ms for r in h.where("hop_number = 1").collect()} == {"a": 13.0, "b": 22.0, "c": 31.0}
    assert h.count() == 15 and synthetic.metric_updates(h).groupBy("measurement_id").count().where("count = 20").count() == 2
    who = spark.createDataFrame([("Asia/Seoul", None), ("Asia/Tokyo", "en"), (None, None), ("x", "ko-KR")], "tz string, locale string")
    assert [r[0] for r in who.select(synthetic.origin(F.col("tz"), F.col("locale"))[0]).collect()] == ["Seoul", "Tokyo", "Nearest available city", "Seoul"]


def test_words_and_addresses_of_odd_lines(spark):
    from pathloom.functions import net
    from pathloom.functions import text as t

    rows = [("\ta\x0bb  c\u00a0d\r\n", None), ("12%", 12.0), ("%", 0.0), ("5%%", None), ("1e3", 1000.0), ("NaN", None), ("-.5", -0.5)]
    df = spark.createDataFrame(rows, "s string, n double")
    got = df.select(t.words(F.col("s")).alias("w"), t.number_of_word(F.col("s")).alias("n"), t.number(F.col("s")).alias("old")).collect()
    assert got[0].w == ["a", "b", "c\u00a0d"] and all(g.n == g.old == r[1] for g, r in zip(got[1:], rows[1:]))
    ips = [("10.1.2.3", True), ("10. .2.3", True), ("172.16.", False), ("172.31.0.1", True), ("10.x.0.1", False), ("256.1.1.1", False), (None, False), ("192.168..1", True)]
    assert [r.p for r in spark.createDataFrame(ips, "ip string, want boolean").select(net.is_private(F.col("ip")).alias("p")).collect()] == [w for _, w in ips]
    assert [r[0] for r in spark.createDataFrame([("x 1.2.3 256.1.1.1 007.1.2.3",), ("1.2.3.4.5 1.2.3.999",)], "s string").select(t.ipv4_in(F.col("s"))).collect()] == ["007.1.2.3", None]


def test_payloads_are_parsed_in_one_pass(spark, tmp_path):
    """Objects and lines of text come from one reading of the payloads, each with its own fields."""
    from pathloom.operators import decode

    told = [
        ("a", '{"result":{"hops":[{"ip":" 9.9.9.9 ","autonomousSystem":"as7","rtt":"5","lat":"50 ","lon":" 5%"},{"as":{"id":{"value":12}},"stats":{"avg":2.4,"loss":" 7%"}}]}}'),
        ("b", '{"result":[{"hop":4,"ip":"10.0.0.1","rtt":7,"packetLoss":"3"},3,null]}'),
        ("c", '{"rawOutput":"1 AS15169 h.net 142.250.206.14 20 ms\\n  \\nno hop\\n2 * * *"}'), ("d", '{"rawOutput":5}'), ("e", "{"), ("f", None),
    ]
    spark.createDataFrame(told, "k string, payload string").coalesce(1).write.parquet(str(tmp_path / "p"))
    out = decode.json_hops(spark.read.parquet(str(tmp_path / "p")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.lower().count("parsejson") == 1
    got = {(r.k, r.hop_seq): (r.hop_number, r.asn, r.ip, r.latitude, r.longitude, r.rtt_ms, r.packet_loss_percent, r.status) for r in out.collect()}
    assert got == {
        ("a", 1): (1, "AS7", "9.9.9.9", 50.0, 5.0, None, None, "timeout"), ("a", 2): (2, "AS12", None, None, None, 2.0, 7.0, "ok"),
        ("b", 1): (4, "AS???", "10.0.0.1", None, None, 7.0, None, "ok"), ("b", 2): (2, None, None, None, None, None, None, "timeout"),
        ("b", 3): (3, None, None, None, None, None, None, "timeout"),
        ("c", 1): (1, "AS15169", "142.250.206.14", None, None, 20.0, 0.0, "ok"), ("c", 4): (2, None, None, None, None, None, 100.0, "loss"),
    }
