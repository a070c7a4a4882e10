"""Dimension tables: places, metropolitan areas, districts, networks, countries, address ranges."""

from __future__ import annotations

from ipaddress import ip_address

from pyspark.sql import DataFrame, SparkSession

# City hints in match order: city, country, latitude, longitude, aliases in match order.
CITIES = [
    ("Seoul", "KR", 37.5665, 126.978, ("seoul", "sel", "icn")),
    ("Tokyo", "JP", 35.6762, 139.6503, ("tokyo", "tyo", "nrt", "hnd", "jtha")),
    ("Osaka", "JP", 34.6937, 135.5023, ("osaka", "osa", "kix")),
    ("Hong Kong", "HK", 22.3193, 114.1694, ("hongkong", "hong-kong", "hkg", "hkth")),
    ("Taipei", "TW", 25.033, 121.5654, ("taipei", "tpe")),
    ("Singapore", "SG", 1.3521, 103.8198, ("singapore", "sin", "sgp")),
    ("Sydney", "AU", -33.8688, 151.2093, ("sydney", "syd", "ksyd")),
    ("Melbourne", "AU", -37.8136, 144.9631, ("melbourne", "mel")),
    ("Frankfurt", "DE", 50.1109, 8.6821, ("frankfurt", "fra", "rhr", "kae")),
    ("Amsterdam", "NL", 52.3676, 4.9041, ("amsterdam", "ams")),
    ("London", "GB", 51.5072, -0.1276, ("london", "lon", "lhr", "lgw", "ulhc")),
    ("Paris", "FR", 48.8566, 2.3522, ("paris", "par", "cdg")),
    ("Warsaw", "PL", 52.2297, 21.0122, ("warsaw", "waw")),
    ("New York", "US", 40.7128, -74.006, ("newyork", "new-york", "nyc", "jfk", "ewr")),
    ("Ashburn", "US", 39.0438, -77.4874, ("ashburn", "iad", "iad1")),
    ("Chicago", "US", 41.8781, -87.6298, ("chicago", "chi", "ord")),
    ("Dallas", "US", 32.7767, -96.797, ("dallas", "dfw", "dal")),
    ("Los Angeles", "US", 34.0522, -118.2437, ("losangeles", "los-angeles", "lax")),
    ("San Jose", "US", 37.3382, -121.8863, ("sanjose", "san-jose", "sjc")),
    ("San Francisco", "US", 37.7749, -122.4194, ("sanfrancisco", "san-francisco", "sfo")),
    ("Seattle", "US", 47.6062, -122.3321, ("seattle", "sea")),
]
# Metropolitan areas in match order: key, label, country, latitude, longitude, radius in km, latency in ms.
METROS = [
    ("seoul-metro", "Seoul metro", "KR", 37.5665, 126.978, 85.0, 28.0),
    ("tokyo-metro", "Tokyo metro", "JP", 35.6762, 139.6503, 80.0, 24.0),
    ("hong-kong-metro", "Hong Kong", "HK", 22.3193, 114.1694, 45.0, 18.0),
    ("frankfurt-metro", "Frankfurt metro", "DE", 50.1109, 8.6821, 95.0, 24.0),
]
# Cities that count as part of a metropolitan area.
METRO_CITIES = {
    "seoul-metro": [
        "seoul", "incheon", "bucheon", "gimpo", "gwangmyeong", "anyang", "gwacheon", "gunpo", "uiwang", "suwon", "seongnam", "bundang", "hanam", "guri",
        "namyangju", "yongin", "goyang", "paju", "uijeongbu",
    ],
    "tokyo-metro": ["tokyo", "yokohama", "kawasaki", "saitama", "chiba"],
    "hong-kong-metro": ["hong kong", "hongkong", "kowloon", "wan chai", "central", "tsuen wan", "new territories"],
    "frankfurt-metro": ["frankfurt", "karlsruhe", "rüsselsheim", "ruesselsheim", "offenbach", "mainz", "wiesbaden"],
}
# Districts that count as Hong Kong.
HONG_KONG_DISTRICTS = ["wan chai", "central", "kowloon", "tsuen wan", "new territories"]
# Networks: number, name, country.
NETWORKS = [
    ("AS15169", "Google LLC", "US"),
    ("AS13335", "Cloudflare", "US"),
    ("AS4637", "Telstra Global", "AU"),
    ("AS63473", "HostHatch", "US"),
    ("AS8560", "IONOS SE", "DE"),
    ("AS3356", "Lumen", "US"),
    ("AS64512", "Private network", "Private"),
    ("AS9318", "SK Broadband", "KR"),
]
# Country centres, by code or part of the name; anything else is at 25/20.
CENTROIDS = [
    ("KR", "korea", 37.57, 126.98), ("JP", "japan", 35.68, 139.76), ("SG", "singapore", 1.35, 103.82), ("US", "united states", 39.82, -98.58),
    ("DE", "germany", 51.16, 10.45), ("GB", "united kingdom", 55.37, -3.44), ("AU", "australia", -25.27, 133.77), ("HK", "hong kong", 22.3193, 114.1694),
    ("CN", "china", 35.86, 104.2), ("FR", "france", 46.23, 2.21), ("NL", "netherlands", 52.13, 5.29), ("CA", "canada", 56.13, -106.35),
]
DEFAULT_CENTROID = (25.0, 20.0)
# Country names by canonical code.
COUNTRY_NAMES = {
    "hk": ["hk", "hong kong"], "kr": ["kr", "south korea", "korea", "republic of korea"], "jp": ["jp", "japan"], "tw": ["tw", "taiwan"],
    "sg": ["sg", "singapore"], "us": ["us", "usa", "united states"], "gb": ["gb", "uk", "united kingdom"], "de": ["de", "germany"], "au": ["au", "australia"],
}
# IPv4 ranges that a target may not lie in.
BLOCKED_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
]
# IPv6 ranges that a target may not lie in.
BLOCKED_V6 = ["::/128", "::1/128", "::ffff:0:0/96", "64:ff9b::/96", "100::/64", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8"]
# Suffixes of domains that are not public.
RESERVED_SUFFIXES = [".localhost", ".local", ".localdomain", ".lan", ".home", ".internal", ".test", ".example", ".invalid"]


def v4_range(cidr: str) -> tuple[int, int]:
    """The first and last address of a range, as numbers."""
    base, bits = cidr.split("/")
    number = 0
    for octet in base.split("."):
        number = number * 256 + int(octet)
    size = 1 << (32 - int(bits))
    low = number // size * size
    return low, low + size - 1


def v6_range(cidr: str) -> tuple[list[int], int]:
    """The eight groups of a range's first address, and its prefix length."""
    base, bits = cidr.split("/")
    return [int.from_bytes(ip_address(base).packed[i : i + 2]) for i in range(0, 16, 2)], int(bits)


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """An inline table, which the optimizer sees into and which needs no Python at run time."""
    one = lambda v: "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else f"{v}L" if isinstance(v, int) and abs(v) >= 1 << 31 else str(v)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)} AS t({columns})")


def cities(spark: SparkSession) -> DataFrame:
    """(ord, city, country, latitude, longitude), ord from 0 in match order."""
    return _values(spark, [(i, *c[:4]) for i, c in enumerate(CITIES)], "ord, city, country, latitude, longitude")


def city_aliases(spark: SparkSession) -> DataFrame:
    """(city_ord, alias_ord, alias), both numbers from 0 in match order."""
    return _values(spark, [(i, j, a) for i, c in enumerate(CITIES) for j, a in enumerate(c[4])], "city_ord, alias_ord, alias")


def networks(spark: SparkSession) -> DataFrame:
    return _values(spark, NETWORKS, "asn, name, country")


def ranges(spark: SparkSession, cidrs: list[str]) -> DataFrame:
    """(cidr) of a list of ranges."""
    return _values(spark, [(c,) for c in cidrs], "cidr")


def areas(spark: SparkSession) -> DataFrame:
    """(ord, area, cc, latitude, longitude, radius_km) of the metropolitan areas, ord from 0 in match order."""
    return _values(spark, [(i, m[0], m[2].lower(), m[3], m[4], m[5]) for i, m in enumerate(METROS)], "ord, area, cc, latitude, longitude, radius_km")


def area_cities(spark: SparkSession) -> DataFrame:
    """(area, name) of the cities that count as part of an area."""
    return _values(spark, [(a, c) for a, names in METRO_CITIES.items() for c in names], "area, name")
