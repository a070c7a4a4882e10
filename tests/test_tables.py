"""The fixed tables against values written out here, so that a table and a query over it can't be wrong together."""

from ipaddress import ip_address, ip_network

from pathloom.functions import net
from pathloom.sources import dims

NEVER_LOOKED_UP = "0.0.0.1 10.0.0.1 100.64.0.1 127.0.0.1 169.254.1.1 172.16.0.1 192.0.2.1 192.168.0.1 198.51.100.1 203.0.113.1 224.0.0.1".split()
PUBLIC = "1.1.1.1 8.8.8.8 9.9.9.9 142.250.206.14 172.15.0.1 172.32.0.1 100.128.0.1 192.167.0.1 198.20.0.1 223.255.255.255".split()


def within(ip, ranges):
    return any(ip_address(ip) in ip_network(r) for r in ranges)


def test_ranges():
    assert all(within(x, net.NOT_LOOKED_UP) for x in NEVER_LOOKED_UP) and not any(within(x, net.NOT_LOOKED_UP) for x in PUBLIC)
    assert all(within(x, dims.BLOCKED_V4) for x in NEVER_LOOKED_UP) and not any(within(x, dims.BLOCKED_V4) for x in PUBLIC)
    # A target may be where nothing is looked up.
    assert within("192.0.1.1", net.NOT_LOOKED_UP) and not within("192.0.1.1", dims.BLOCKED_V4)
    for low, high in map(dims.v4_range, dims.BLOCKED_V4):
        assert low <= high
    assert dims.v4_range("100.64.0.0/10") == (1681915904, 1686110207)
    assert all(within(x, dims.BLOCKED_V6) for x in ("::", "::1", "::ffff:1.2.3.4", "64:ff9b::1", "100::1", "2001:db8::1", "fd00::1", "fe80::1", "ff02::1"))
    assert not any(within(x, dims.BLOCKED_V6) for x in ("2606:4700::1111", "2001:4860:4860::8888", "100:1::"))


def test_places():
    assert [c[0] for c in dims.CITIES] == [
        "Seoul", "Tokyo", "Osaka", "Hong Kong", "Taipei", "Singapore", "Sydney", "Melbourne", "Frankfurt", "Amsterdam", "London", "Paris", "Warsaw", "New York",
        "Ashburn", "Chicago", "Dallas", "Los Angeles", "San Jose", "San Francisco", "Seattle",
    ]
    at = {c[0]: c[1:4] for c in dims.CITIES}
    assert at["Seoul"] == ("KR", 37.5665, 126.978) and at["Tokyo"] == ("JP", 35.6762, 139.6503) and at["Seattle"] == ("US", 47.6062, -122.3321)
    assert [(m[0], m[2], m[5]) for m in dims.METROS] == [("seoul-metro", "KR", 85.0), ("tokyo-metro", "JP", 80.0), ("hong-kong-metro", "HK", 45.0), ("frankfurt-metro", "DE", 95.0)]
    assert {m[0] for m in dims.METROS} == set(dims.METRO_CITIES) and "incheon" in dims.METRO_CITIES["seoul-metro"] and "yokohama" in dims.METRO_CITIES["tokyo-metro"]
    aliases = [a for c in dims.CITIES for a in c[4]]
    assert len(aliases) == len(set(aliases)) and {"icn", "nrt", "fra", "sjc", "jfk"} <= set(aliases)


def test_networks():
    assert dict((n[0], n[1]) for n in dims.NETWORKS)["AS15169"] == "Google LLC" and len(dims.NETWORKS) == 8
    assert [r[0] for r in net.ASN_RULES] == ["AS15169", "AS13335", "AS8560", "AS4637"]
