from pyspark.sql import functions as F

from pathloom.operators import decode
from pathloom.operators import requests as rq
from pathloom.sources import lookup


def test_where_and_how(spark):
    df = spark.createDataFrame([("Asia/Seoul", None), ("Asia/Tokyo", "en"), ("America/Los_Angeles", "ko-KR"), ("America/New_York", "en"), (None, None)], "tz string, locale string")
    assert [r[0] for r in df.select(rq.probe_region(F.col("tz"), F.col("locale"))).collect()] == ["South Korea", "Japan", "South Korea", "New York", "World"]
    m = spark.createDataFrame([("mtr",), ("traceout",)], "mode string")
    body = rq.request_body(F.lit("a.net"), F.col("mode"), F.lit("TCP"), F.lit("World"))
    assert [r[0] for r in m.select(body).collect()] == [
        '{"type":"mtr","target":"a.net","locations":[{"magic":"World"}],"limit":1,"measurementOptions":{"protocol":"TCP","packets":16}}',
        '{"type":"traceroute","target":"a.net","locations":[{"magic":"World"}],"limit":1,"measurementOptions":{"protocol":"ICMP"}}',
    ]


def test_retry_and_end(spark):
    rows = [("mtr", 0, "Private IP ranges"), ("mtr", 1, "not allowed"), ("traceout", 0, "not allowed"), ("mtr", 0, "timed out"), ("mtr", 0, None)]
    df = spark.createDataFrame(rows, "mode string, i int, failure string")
    assert [r[0] for r in df.select(rq.retries_with(F.col("mode"), F.col("i"), F.col("failure"))).collect()] == [1, None, None, None, None]
    df = spark.createDataFrame([("finished", 0), ("in-progress", 0), (None, 2), (None, None)], "s string, n int")
    assert [r[0] for r in df.select(rq.is_over(F.col("s"), F.col("n"))).collect()] == [True, False, True, False]
    df = spark.createDataFrame([("", "10.0.0.1"), ("1.1.1.1", "x"), (None, None)], "ip string, a string")
    assert [r[0] for r in df.select(rq.client_key(F.col("ip"), F.col("a"))).collect()] == ["10.0.0.1", "1.1.1.1", "unknown"]


def test_payload_parts(spark):
    df = spark.createDataFrame([('{"results":[{"probe":{"id":"p","city":"Seoul","country":1,"asn":9318,"latitude":37.5}},{}]}',), ('{"results":[]}',), ("no json",), (None,)], "payload string")
    got = rq.probe_sources(rq.first_results(df)).collect()
    s = got[0].source
    assert (s.probe_id, s.city, s.country, s.asn, s.latitude, s.longitude) == ("p", "Seoul", None, "AS9318", 37.5, None)
    assert [r.source.city for r in got[1:]] == [None] * 3


def test_lookup_records(spark):
    assert [lookup.vendor(e) for e in ({}, {"IPINFO_TOKEN": "x"}, {"GEOIP_PROVIDER": "ip-api"}, {"GEOIP_PROVIDER": "none", "IPINFO_TOKEN": "x"})] == ["none", "ipinfo", "ip-api", "none"]
    a = spark.createDataFrame([("8.8.8.8", "37.4,-122.1", "AS15169 Google LLC", "x", "US", None), ("1.1.1.1", None, None, None, None, None), ("2.2.2.2", "a,1", "none", None, None, None)], "ip string, loc string, org string, city string, country string, hostname string")
    got = {r.ip: r for r in lookup.joined_coordinates(a).collect()}
    assert (got["8.8.8.8"].geo_latitude, got["8.8.8.8"].geo_longitude, got["8.8.8.8"].geo_asn, got["8.8.8.8"].geo_as_name) == (37.4, -122.1, "AS15169", "Google LLC")
    assert got["1.1.1.1"].geo_latitude is None and (got["2.2.2.2"].geo_latitude, got["2.2.2.2"].geo_longitude, got["2.2.2.2"].geo_asn) == (None, 1.0, None)
    b = spark.createDataFrame([("8.8.8.8", "success", "Germany", "DE", "x", 1.0, 2.0, "AS1 One", None, "r"), ("1.1.1.1", "fail", None, None, None, None, None, None, None, None)], "ip string, status string, country string, countryCode string, city string, lat double, lon double, `as` string, asname string, reverse string")
    (r,) = lookup.with_status(b).collect()
    assert (r.ip, r.geo_country, r.geo_asn, r.geo_as_name, r.geo_hostname) == ("8.8.8.8", "DE", "AS1", "One", "r")


def test_the_network_of_a_probe_may_be_an_object(spark):
    said = ['{"probe":{"asn":{"number":9318}}}', '{"probe":{"asn":{"id":{"value":"AS13335 x"}}}}', '{"probe":{"asn":{"name":"none"}}}', '{"probe":{"asn":"as 7"}}', '{"probe":7}', None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, payload string")
    got = {r.i: r.asn for r in decode.json_sources(df).select("i", "source.asn").collect()}
    assert [got[i] for i in range(6)] == ["AS9318", "AS13335", None, "AS7", None, None]
