import pytest
from pyspark.sql import functions as F

from pathloom.functions import geo, net
from pathloom.functions import text as t
from pathloom.operators import decode, report, route
from pathloom.sources import dims


def column(spark, kind, values, f):
    """f over a column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_asn_text(spark):
    texts = ["AS15169 edge", "as 77", "BIAS12", "x AS3 AS4", "", None]
    assert column(spark, "string", texts, t.asn_digits) == ["15169", "77", None, "3", None, None]
    assert column(spark, "string", ["15169", " AS9 ", "AS???", "12345678901", "x"], t.normal_asn) == ["AS15169", "AS9", "AS???", None, None]
    assert column(spark, "string", ["AS15169 Google LLC", "Google", "AS1 "], t.without_asn_prefix) == ["Google LLC", "Google", None]


def test_numbers(spark):
    assert column(spark, "string", ["12", " 3.5% ", "", "5d", "NaN", "0x10", "1e3", None], t.number) == [12.0, 3.5, 0.0, None, None, None, 1000.0, None]
    assert column(spark, "string", ["1.", ".", "1.2.3", "12", ""], t.is_decimal) == [True, False, False, True, False]


def test_scans(spark):
    assert column(spark, "string", ["1.2.3 ms", "20.2 ms 22.7 MS 21.1ms", "7 m", "none"], t.rtt_values) == [[3.0], [20.2, 22.7, 21.1], [], []]
    assert column(spark, "string", ["1e100.net 142.250.206.14", "1.2.3.4.5 8.8.8.8", "300.1.1.1", None], t.ipv4_in) == ["142.250.206.14", "8.8.8.8", None, None]
    assert column(spark, "string", ["<a href='x'>&"], t.html_escaped) == ["&lt;a href=&#39;x&#39;&gt;&amp;"]


def test_address_classes(spark):
    never = ["0.0.0.1", "10.0.0.1", "100.64.0.1", "127.0.0.1", "169.254.1.1", "172.16.0.1", "192.0.2.1", "192.168.0.1", "198.51.100.1", "203.0.113.1", "224.0.0.1", "::1", None]
    assert column(spark, "string", never, net.is_public) == [False] * len(never)
    # The three classes differ on purpose.
    assert column(spark, "string", ["192.0.1.1"], net.is_public) == [False] and column(spark, "string", ["192.0.1.1"], net.is_blocked) == [False]
    assert column(spark, "string", ["10...", "172.20.0.1", "8.8.8.8"], net.is_private) == [True, True, False]
    assert column(spark, "string", ["::1", "2001:db8::5", "2606:4700::1111", "fe80::1", "x"], net.is_blocked_v6) == [True, True, False, True, None]


def test_targets(spark):
    rows = [" Example.COM ", "1.1.1.1", "https://example.com", "example.com; rm -rf /", "localhost", "10.0.0.1", "192.0.2.10", "a.local", "", "x" * 254, "192.0.1.1", "2606:4700::1111", "::1"]
    got = column(spark, "string", rows, lambda x: F.array(*net.normal_target(x)))
    e = net.ERRORS
    assert got == [["example.com", None], ["1.1.1.1", None], [None, e["url"]], [None, e["url"]], [None, e["invalid"]], [None, e["public"]], [None, e["public"]], [None, e["public"]], [None, e["length"]], [None, e["length"]], ["192.0.1.1", None], ["2606:4700::1111", None], [None, e["public"]]]
    assert column(spark, "string", ["mtr", "traceout", "ping"], net.normal_mode) == ["mtr", "traceout", None]


@pytest.mark.parametrize(("rtt", "loss", "want"), [(10, 0, "ok"), (120, None, "ok"), (121, None, "slow"), (None, None, "timeout"), (None, 49, "timeout"), (10, 50, "loss"), (None, 100, "loss")])
def test_status(spark, rtt, loss, want):
    df = spark.createDataFrame([(rtt, loss)], "rtt int, loss int")
    assert df.select(decode.hop_status(F.col("rtt"), F.col("loss"))).first()[0] == want


def test_places(spark):
    km = spark.range(1).select(F.round(geo.haversine(*(F.lit(x) for x in (37.57, 126.98, 35.6762, 139.6503))), 6)).first()[0]
    assert km == 1149.227721
    assert column(spark, "double", [-190.0, 180.0, 190.0, float("nan"), None], geo.wrapped) == [170.0, -180.0, -170.0, 0.0, 0.0]
    assert column(spark, "string", ["South Korea", " uk", "", None, "Narnia"], geo.country_code) == ["kr", "gb", None, None, "narnia"]
    assert column(spark, "string", ["Hong_Kong", "St.-Denis"], geo.city_name) == ["hong kong", "st  denis"]
    assert column(spark, "double", [10.0, 30.0, 60.0, 90.0], geo.zoom_for) == [6.25, 4.85, 4.15, 3.75]
    assert column(spark, "double", [320.0, 100.0], lambda w: F.round(geo.minimum_zoom(w), 3)) == [1.2, 1.2]
    assert dims.v4_range("172.16.0.0/12") == (2886729728, 2887778303)


def test_labels(spark):
    assert column(spark, "array<int>", [[1, 2, 3, 5, 3], [4], [], [0, -1]], route.hop_ranges) == ["Mapped hops 1-3, 5", "Mapped hop 4", None, None]
    assert column(spark, "double", [0.15, 0.25, 0.35, 2.0, 33.3], route.loss_label) == ["0.1%", "0.3%", "0.3%", "2%", "33.3%"]
    assert column(spark, "array<string>", [["a", "b", "a"], ["a", "b", "c"], [], ["", None]], lambda v: route.listed(v, " AS", F.lit("-"))) == ["a / b", "a +2 AS", "-", "-"]
    hop = spark.createDataFrame([(1, 21.0, "ok", "h", "1.1.1.1"), (12, 1234.0, "timeout", "1.1.1.1", "1.1.1.1")], "hop_number int, rtt_ms double, status string, hostname string, ip string")
    assert [r[0] for r in hop.select(report.trace_line(hop)).collect()] == [" 1   21 ms  ok       h (1.1.1.1)", "12  1234 ms  timeout  1.1.1.1"]
