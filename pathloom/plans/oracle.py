"""The queries in SQL over the same tables, for queries that SQL can express; names of columns agree."""

from __future__ import annotations

from pathloom.sources.dims import METRO_CITIES
from pathloom.functions.net import ASN_RULES, ERRORS, NOT_LOOKED_UP
from pathloom.operators.report import CAP_NOTICE, NOTICES
from pathloom.sources import dims


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(xs) -> str:
    return "[" + ", ".join(text(x) if isinstance(x, str) else f"{x!r}::DOUBLE" for x in xs) + "]"


def city(field: int, at: str) -> str:
    return f"{values([c[field] for c in dims.CITIES])}[{at} + 1]"


FIRST_ALIAS = values([c[4][0] for c in dims.CITIES])
NETWORKS = "(VALUES " + ", ".join(f"({text(a)}, {text(n)}, {text(c)})" for a, n, c in dims.NETWORKS) + ") AS n(asn, name, country)"

HOPS = f"""line AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn, l_suppkey AS s, l_partkey AS p FROM lineitem
), hop0 AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS measurement_id, CAST(rn AS INT) AS hop_seq, CAST(rn AS INT) AS hop_number,
    CASE WHEN s % 10 = 8 THEN 'AS???' WHEN s % 10 = 9 THEN 'AS' || (1000 + s) ELSE {values([n[0] for n in dims.NETWORKS])}[s % 10 + 1] END AS asn,
    CASE p % 6 WHEN 0 THEN '10.' || s % 200 || '.' || p % 250 || '.1' WHEN 1 THEN '172.' || (10 + s % 30) || '.' || p % 250 || '.2'
      WHEN 2 THEN '142.250.' || s % 200 || '.' || p % 250 WHEN 3 THEN '203.0.' || s % 200 || '.' || p % 250 WHEN 4 THEN '82.165.' || s % 200 || '.' || p % 250 END AS ip,
    CASE WHEN p % 5 <> 0 THEN 'ae1-' || {FIRST_ALIAS}[p % 21 + 1] || s % 9 || '.core.example.net' END AS hostname,
    CASE WHEN s % 22 < 21 THEN {city(0, "s % 22")} END AS city, CASE WHEN s % 22 < 21 THEN {city(1, "s % 22")} END AS country,
    CASE WHEN s % 22 < 21 AND l_linestatus = 'F' THEN {city(2, "s % 22")} END AS latitude, CASE WHEN s % 22 < 21 AND l_linestatus = 'F' THEN {city(3, "s % 22")} END AS longitude,
    CASE WHEN p % 3 = 0 THEN 'medium' ELSE 'high' END AS location_confidence,
    CASE WHEN p % 11 <> 0 THEN l_quantity * 4 END AS rtt_ms, CAST(trunc(l_tax * 100) AS DOUBLE) AS jitter_ms, CASE WHEN p % 13 <> 0 THEN round(l_discount * 1000) END AS packet_loss_percent
  FROM line
), hops AS (
  SELECT *, CASE WHEN packet_loss_percent >= 50 THEN 'loss' WHEN rtt_ms IS NULL THEN 'timeout' WHEN rtt_ms > 120 THEN 'slow' ELSE 'ok' END AS status FROM hop0
)"""
SOURCES = f"""sources AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS measurement_id, {city(0, "c_nationkey % 21")} AS src_city, {city(1, "c_nationkey % 21")} AS src_country,
    {city(2, "c_nationkey % 21")} AS src_latitude, {city(3, "c_nationkey % 21")} AS src_longitude
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
EVENTS = """ev AS (
  SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, epoch_us(ts) // 1000 AS ts_ms,
    CASE event_type WHEN 'signup' THEN 'measurement_started' WHEN 'view' THEN 'hop_result' WHEN 'click' THEN 'metric_update' WHEN 'purchase' THEN 'measurement_finished' WHEN 'error' THEN 'error' END AS type,
    k % 8 + 1 AS hop_number, CASE WHEN k % 4 <> 0 THEN value END AS rtt_ms, CASE WHEN k % 3 <> 0 THEN 'h' || k END AS hostname,
    CASE WHEN k % 5 <> 0 THEN value / 2 END AS jitter_ms, CASE WHEN k % 7 <> 0 THEN CAST(k % 100 AS DOUBLE) END AS packet_loss_percent, CASE WHEN k % 2 = 0 THEN 'AS' || k END AS asn,
    CASE WHEN k % 11 <> 0 THEN ['ok', 'slow', 'loss', 'timeout'][k % 4 + 1] END AS status, value, k
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
)"""


EVENT_FIELDS = ["asn", "hostname", "rtt_ms", "jitter_ms", "packet_loss_percent", "status"]
LATEST = "max_by({0}, seq) FILTER ({1}) AS {0}"


def octet(ip: str, i: int) -> str:
    return f"CAST(split_part({ip}, '.', {i}) AS BIGINT)"


def number(ip: str) -> str:
    return f"(({octet(ip, 1)} * 256 + {octet(ip, 2)}) * 256 + {octet(ip, 3)}) * 256 + {octet(ip, 4)}"


def within(n: str, ranges: list[str]) -> str:
    return "(" + " OR ".join("{} BETWEEN {} AND {}".format(n, *dims.v4_range(c)) for c in ranges) + ")"


PRIVATE = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10"]


def inferred(ip: str, host: str) -> str:
    ip, host = f"coalesce({ip}, '')", f"lower(coalesce({host}, ''))"
    out = f"CASE WHEN {ip} <> '' AND {within(number(f'nullif({ip}, chr(32))'), PRIVATE)} THEN 'AS???'"
    for asn, names, starts, exact in ASN_RULES:
        tests = [f"contains({host}, {text(x)})" for x in names] + [f"starts_with({ip}, {text(x)})" for x in starts] + ([f"{ip} = {text(exact)}"] if exact else [])
        out += f" WHEN {' OR '.join(tests)} THEN {text(asn)}"
    return (out + " END").replace("nullif(coalesce", "nullif(coalesce")


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def code(c: str) -> str:
    c = f"trim(lower({c}))"
    return f"CASE WHEN {c} = '' THEN NULL " + " ".join(f"WHEN {c} IN ({', '.join(map(text, ns))}) THEN {text(k)}" for k, ns in dims.COUNTRY_NAMES.items()) + f" ELSE {c} END"


def label(c: str) -> str:
    n = f"lower(coalesce({c}, ''))"
    pairs = [("kr", "korea", "KR"), ("jp", "japan", "JP"), ("us", "united states", "US"), ("gb", "united kingdom", "UK")]
    return "CASE " + " ".join(f"WHEN {n} = '{k}' OR contains({n}, '{p}') THEN '{s}'" for k, p, s in pairs) + f" WHEN {n} = 'hong kong' THEN 'Hong Kong' WHEN {n} = 'germany' THEN 'DE' WHEN {n} = 'australia' THEN 'AU' ELSE {c} END"


def metro(city_: str, cc: str, lat: str, lon: str) -> str:
    """The number of the metropolitan area, from 0."""
    return "CASE " + " ".join(
        f"WHEN {code(cc)} = {text(m[2].lower())} AND (lower({city_}) IN ({', '.join(map(text, METRO_CITIES[m[0]]))}) OR {haversine(lat, lon, repr(m[3]), repr(m[4]))} <= {m[5]}) THEN {i}" for i, m in enumerate(dims.METROS)
    ) + " END"


LOSS = "CASE WHEN {0} % 1 = 0 THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) || '%' ELSE CAST(CAST(round(CAST({0} AS DECIMAL(38, 20)), 1) AS DECIMAL(20, 1)) AS VARCHAR) || '%' END"
NETWORK_JOIN = f"LEFT JOIN (SELECT asn AS n_asn, name AS n_name, country AS n_country FROM {NETWORKS}) ON asn = n_asn"
SEGMENTS = f"""placed AS (
  SELECT *, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN coalesce(city, hostname, ip, 'Network') END AS place_city,
    CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN coalesce({label("country")}, 'Unknown') END AS place_country FROM hops {NETWORK_JOIN}
), keyed AS (
  SELECT *, lower(place_city) || ':' || lower(place_country) AS place, asn || ':' || coalesce(lower(place_city) || ':' || lower(place_country), n_country, 'unknown') AS k FROM placed
), marked AS (
  SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY measurement_id ORDER BY hop_seq) THEN 0 ELSE 1 END AS new FROM keyed
), numbered AS (
  SELECT *, CAST(sum(new) OVER (PARTITION BY measurement_id ORDER BY hop_seq) AS INT) AS segment,
    CASE status WHEN 'ok' THEN 1 WHEN 'slow' THEN 2 WHEN 'loss' THEN 3 ELSE 4 END AS rank FROM marked
), segments AS (
  SELECT measurement_id, segment, min_by(asn, hop_seq) AS asn, min_by(n_name, hop_seq) AS name, min_by(place, hop_seq) AS place, min_by(latitude, hop_seq) AS latitude,
    min_by(longitude, hop_seq) AS longitude, CAST(count(*) AS INT) AS n_hops, max(rank) AS rank, ['ok', 'slow', 'loss', 'timeout'][max(rank)] AS status
  FROM numbered GROUP BY measurement_id, segment
)"""
ENDPOINTS = f"""ends AS (
  SELECT s.measurement_id, src_city, {label("src_country")} AS src_country, src_latitude AS src_lat, src_longitude AS src_lon, dst_lat, dst_lon
  FROM sources s LEFT JOIN (SELECT measurement_id, max_by(latitude, hop_seq) AS dst_lat, max_by(longitude, hop_seq) AS dst_lon FROM hops WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1) d
    ON s.measurement_id = d.measurement_id
)"""
ALIASES = "(VALUES " + ", ".join(f"({i}, {j}, {text(a)})" for i, c in enumerate(dims.CITIES) for j, a in enumerate(c[4])) + ") AS a(city_ord, alias_ord, alias)"


def host_match(hosts: str) -> str:
    """CTEs tokens and matched: for each host of a table of hosts the first city hint and alias."""
    return f"""tokens AS (
  SELECT hostname, list_filter(list_transform(regexp_split_to_array(lower(hostname), '[._()\\s-]'), lambda x: regexp_replace(regexp_replace(x, '^[0-9]+', ''), '[0-9]+$', '')), lambda x: x <> '') AS ts FROM {hosts}
), matched AS (
  SELECT hostname, min_by(city_ord, city_ord * 100 + alias_ord) AS city_ord, min_by(alias, city_ord * 100 + alias_ord) AS alias FROM tokens, {ALIASES}
  WHERE list_contains(ts, alias) OR list_contains(ts, replace(alias, '-', '')) OR (len(alias) >= 4 AND len(list_filter(ts, lambda x: ends_with(x, alias) OR ends_with(x, replace(alias, '-', '')))) > 0)
    OR (len(alias) >= 5 AND (contains(lower(hostname), alias) OR contains(lower(hostname), replace(alias, '-', ''))))
  GROUP BY hostname
)"""


FUSION = f"""WITH {HOPS}, {SOURCES}, pub AS (
  SELECT ip, CAST({octet("ip", 1)} + {octet("ip", 2)} + {octet("ip", 3)} + {octet("ip", 4)} AS INT) % 21 AS loc FROM (SELECT DISTINCT ip FROM hops WHERE ip IS NOT NULL) WHERE NOT {within(number("ip"), NOT_LOOKED_UP)}
), geo AS (
  SELECT ip, {city(0, "loc")} AS geo_city, {city(1, "loc")} AS geo_country, {city(2, "loc")} + 0.25::DOUBLE AS geo_lat, {city(3, "loc")} - 0.25::DOUBLE AS geo_lon,
    'geo-' || {FIRST_ALIAS}[(loc + 1) % 21 + 1] || '.example.org' AS geo_hostname, CASE WHEN loc % 3 <> 0 THEN 'AS' || (2000 + loc) END AS geo_asn, CASE WHEN loc % 3 <> 1 THEN 'Geo network ' || loc END AS geo_as_name FROM pub
), hosts AS (
  SELECT DISTINCT hostname FROM hops WHERE hostname IS NOT NULL UNION SELECT DISTINCT geo_hostname FROM geo
), {host_match("hosts")}, base AS (
  SELECT h.*, src_latitude, src_longitude, {metro("src_city", "src_country", "src_latitude", "src_longitude")} AS src_metro, geo_city, geo_country, geo_lat, geo_lon, geo_hostname
  FROM hops h JOIN sources USING (measurement_id) LEFT JOIN geo ON h.ip = geo.ip
), cand AS (
  SELECT measurement_id, hop_seq, 1 AS ord, 'provider' AS source, city, country, CASE WHEN latitude IS NOT NULL THEN latitude ELSE g[1] END AS lat, CASE WHEN latitude IS NOT NULL THEN longitude ELSE g[2] END AS lon,
    CASE WHEN latitude IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN latitude IS NOT NULL THEN 'provider supplied hop coordinates' ELSE 'provider supplied hop city/country' END AS evidence, src_latitude, src_longitude, src_metro, rtt_ms
  FROM (SELECT *, [{city(2, f"list_position({values([c[0] for c in dims.CITIES])}, city) - 1")}, {city(3, f"list_position({values([c[0] for c in dims.CITIES])}, city) - 1")}] AS g FROM base) WHERE city IS NOT NULL
  UNION ALL SELECT measurement_id, hop_seq, 2, 'reverse_dns', {city(0, "city_ord")}, {city(1, "city_ord")}, {city(2, "city_ord")}, {city(3, "city_ord")}, 'high', 'reverse DNS matched "' || alias || '" in ' || base.hostname, src_latitude, src_longitude, src_metro, rtt_ms
  FROM base JOIN matched ON base.hostname = matched.hostname
  UNION ALL SELECT measurement_id, hop_seq, 3, 'reverse_dns', {city(0, "city_ord")}, {city(1, "city_ord")}, {city(2, "city_ord")}, {city(3, "city_ord")}, 'high', 'reverse DNS matched "' || alias || '" in ' || geo_hostname, src_latitude, src_longitude, src_metro, rtt_ms
  FROM base JOIN matched ON geo_hostname = matched.hostname
  UNION ALL SELECT measurement_id, hop_seq, 4, 'geoip', geo_city, geo_country, geo_lat, geo_lon, 'medium', 'IP GeoIP database match', src_latitude, src_longitude, src_metro, rtt_ms FROM base WHERE geo_city IS NOT NULL
), down AS (
  SELECT *, coalesce(source IN ('geoip', 'provider') AND src_metro = {metro("city", "country", "lat", "lon")} AND rtt_ms <= {values([m[6] for m in dims.METROS])}[src_metro + 1], false) AS hit FROM cand
), moved AS (
  SELECT measurement_id, hop_seq, ord, source, src_latitude, src_longitude, rtt_ms, CASE WHEN hit THEN {values([m[1] for m in dims.METROS])}[src_metro + 1] ELSE city END AS city, CASE WHEN hit THEN {values([m[2] for m in dims.METROS])}[src_metro + 1] ELSE country END AS country,
    CASE WHEN hit THEN {values([m[3] for m in dims.METROS])}[src_metro + 1] ELSE lat END AS lat, CASE WHEN hit THEN {values([m[4] for m in dims.METROS])}[src_metro + 1] ELSE lon END AS lon, CASE WHEN hit THEN 'medium' ELSE confidence END AS confidence, CASE WHEN hit THEN 'metro' ELSE 'city' END AS precision,
    CASE WHEN hit THEN evidence || '; Public geolocation is inside the same low-latency ' || {values([m[1] for m in dims.METROS])}[src_metro + 1] || '; downgraded to metro-level estimate' ELSE evidence END AS evidence
  FROM down
), sane AS (
  SELECT *, {haversine("src_latitude", "src_longitude", "lat", "lon")} AS far FROM moved WHERE rtt_ms IS NULL OR rtt_ms <= 0 OR {haversine("src_latitude", "src_longitude", "lat", "lon")} <= greatest(900, rtt_ms * 145)
), filtered AS (
  SELECT * FROM sane c WHERE NOT (source IN ('geoip', 'provider') AND EXISTS (
    SELECT 1 FROM sane s WHERE s.measurement_id = c.measurement_id AND s.hop_seq = c.hop_seq AND s.source = 'reverse_dns' AND {haversine("c.lat", "c.lon", "s.lat", "s.lon")} >= 120
      AND ({code("c.country")} <> {code("s.country")} OR {haversine("c.lat", "c.lon", "s.lat", "s.lon")} > 320)))
), agreed AS (
  SELECT c.measurement_id, c.hop_seq, c.ord, CAST(sum(CASE WHEN {haversine("c.lat", "c.lon", "o.lat", "o.lon")} < 90 THEN 12 WHEN {code("c.country")} = {code("o.country")} THEN 4 ELSE 0 END) AS INT) AS points
  FROM filtered c JOIN filtered o ON c.measurement_id = o.measurement_id AND c.hop_seq = o.hop_seq AND c.ord <> o.ord GROUP BY ALL
), scored AS (
  SELECT f.*, CAST(CASE confidence WHEN 'high' THEN 30 ELSE 20 END + CASE source WHEN 'reverse_dns' THEN 14 WHEN 'provider' THEN 12 ELSE 8 END + coalesce(points, 0)
    + CASE WHEN rtt_ms IS NULL OR rtt_ms <= 0 THEN 0 WHEN far < 120 AND rtt_ms <= 12 THEN 12 WHEN far < 900 AND rtt_ms <= 28 THEN 8 WHEN far < 2800 AND rtt_ms <= 75 THEN 5 ELSE 0 END AS INT) AS score
  FROM filtered f LEFT JOIN agreed a ON f.measurement_id = a.measurement_id AND f.hop_seq = a.hop_seq AND f.ord = a.ord
)"""
DEMO = """demo AS (
  SELECT s_suppkey AS measurement_id, CASE s_suppkey % 3 WHEN 0 THEN '1.1.1.1' WHEN 1 THEN 'www.google.com' ELSE 'example.com' END AS target, s_suppkey % 2 = 0 AS mtr,
    CASE s_suppkey % 3 WHEN 0 THEN 13 WHEN 1 THEN 22 ELSE 31 END AS base, n, CAST(n AS INT) AS hop_number, [0, 6, 18, 48, 58][n] AS plus, [2, 3, 5, 9, 6][n] AS jit
  FROM supplier, range(1, 6) AS r(n)
)"""
_loss = LOSS.format("packet_loss_percent")

ORACLE_SQL: dict[str, str] = {
    "hop_status": f"WITH {HOPS} SELECT measurement_id, hop_seq, status FROM hops",
    "measurement_confidence": f"""WITH {HOPS}, c AS (SELECT measurement_id, count(*) AS n_hops, count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS n_located,
      count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL AND location_confidence = 'high') AS n_high FROM hops GROUP BY 1)
      SELECT *, CASE WHEN n_located = 0 THEN 'low' WHEN n_located / n_hops >= 0.58 AND n_high >= ceil(n_located * 0.45::DOUBLE) THEN 'high' WHEN n_located / n_hops >= 0.28 THEN 'medium' ELSE 'low' END AS confidence FROM c""",
    "avg_metrics": f"WITH {HOPS} SELECT measurement_id, round(avg(rtt_ms)) AS avg_rtt_ms, round(avg(packet_loss_percent)) AS avg_loss_percent FROM hops GROUP BY 1",
    "asn_inference": f"WITH {HOPS} SELECT ip, hostname, {inferred('ip', 'hostname')} AS asn FROM (SELECT DISTINCT ip, hostname FROM hops)",
    "asn_from_text": r"""WITH o AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'AS' || s_suppkey || ' ' || s_name WHEN 1 THEN 'via as ' || s_suppkey WHEN 2 THEN 'BIAS' || s_suppkey WHEN 3 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END AS org FROM supplier),
      d AS (SELECT *, nullif(regexp_extract(org, '(?:^|[^A-Za-z0-9])[Aa][Ss]\s*([0-9]+)', 1), '') AS digits FROM o)
      SELECT s_suppkey, org, digits, CASE WHEN regexp_full_match(org, '[0-9]{1,10}') THEN 'AS' || org ELSE 'AS' || digits END AS asn, nullif(regexp_replace(org, '^\s*[Aa][Ss][0-9]+ \s*', ''), '') AS rest FROM d""",
    "ip_classes": f"WITH {HOPS} SELECT ip, {number('ip')} AS number, {within(number('ip'), PRIVATE)} AS is_private, NOT {within(number('ip'), NOT_LOOKED_UP)} AS is_public, {within(number('ip'), dims.BLOCKED_V4)} AS is_blocked FROM (SELECT DISTINCT ip FROM hops WHERE ip IS NOT NULL)",
    "blocked_by_range": f"WITH {HOPS} SELECT ip, cidr FROM (SELECT DISTINCT ip, {number('ip')} AS num FROM hops WHERE ip IS NOT NULL) JOIN (VALUES "
    + ", ".join("({}, {}, {})".format(text(c), *dims.v4_range(c)) for c in dims.BLOCKED_V4)
    + ") AS r(cidr, low, high) ON num BETWEEN low AND high",
    # Block by block from the low end: the largest that begins there and fits.
    "ranges_as_prefixes": f"""WITH RECURSIVE {HOPS}, spans AS (SELECT measurement_id, min({number('ip')}) AS low, max({number('ip')}) AS high FROM hops WHERE ip IS NOT NULL GROUP BY 1),
      powers AS (SELECT k, 1::BIGINT << k AS size FROM (SELECT CAST(unnest(range(0, 33)) AS INT) AS k)),
      walk AS (SELECT measurement_id, low, high, low AS pos, 0::BIGINT AS n, 32 AS shortest FROM spans
        UNION ALL
        SELECT w.measurement_id, low, high, pos + max(size), any_value(n) + 1, least(any_value(shortest), 32 - max(k)) FROM walk w JOIN powers ON pos % size = 0 AND pos + size - 1 <= high WHERE pos <= high GROUP BY w.measurement_id, low, high, pos)
      SELECT measurement_id, low, high, n AS n_prefixes, high - low + 1 AS n_addresses, CAST(shortest AS INT) AS shortest FROM walk WHERE pos = high + 1""",
    "longest_ranges": f"""WITH {HOPS}, a AS (SELECT DISTINCT ip, {number('ip')} AS n FROM hops WHERE ip IS NOT NULL), r AS (
        SELECT DISTINCT ip || '/31' AS cidr, 31 AS bits, n >> 1 AS pos FROM a WHERE n % 4 = 0
        UNION ALL SELECT DISTINCT regexp_replace(ip, '[0-9]+$', '0/24'), 24, n >> 8 FROM a WHERE n % 4 = 1
        UNION ALL SELECT DISTINCT regexp_replace(ip, '[0-9]+[.][0-9]+$', '0.0/16'), 16, n >> 16 FROM a WHERE n % 4 = 2)
      SELECT a.ip, coalesce(x.cidr, y.cidr, z.cidr) AS cidr FROM a LEFT JOIN r x ON x.bits = 31 AND x.pos = n >> 1 LEFT JOIN r y ON y.bits = 24 AND y.pos = n >> 8 LEFT JOIN r z ON z.bits = 16 AND z.pos = n >> 16""",
    "target_validation": f"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, url FROM pages),
      r AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN ' ' || upper(host) || ' ' WHEN 2 THEN '10.0.2.1' WHEN 3 THEN '8.8.' || page_id % 200 || '.8' WHEN 4 THEN host || '.local' ELSE host || '; ls' END AS raw FROM h),
      l AS (SELECT *, lower(trim(raw)) AS t FROM r),
      e AS (SELECT *, CASE WHEN contains(t, '/') OR contains(t, ';') THEN {text(ERRORS['url'])} WHEN regexp_full_match(t, '[0-9.]+') THEN CASE WHEN starts_with(t, '10.') THEN {text(ERRORS['public'])} END
        WHEN regexp_full_match(t, '([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?[.])+[a-z]{{2,63}}') THEN CASE WHEN {' OR '.join(f"ends_with(t, {text(s)})" for s in dims.RESERVED_SUFFIXES)} THEN {text(ERRORS['public'])} END ELSE {text(ERRORS['invalid'])} END AS error FROM l)
      SELECT page_id, raw, CASE WHEN error IS NULL THEN t END AS target, error FROM e""",
    "mode_validation": "SELECT event_id, CASE event_type WHEN 'view' THEN 'mtr' WHEN 'click' THEN 'traceout' END AS mode, CASE WHEN event_type NOT IN ('view', 'click') THEN 'Mode must be traceout or mtr.' END AS error FROM events",
    "page_texts": """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'It failed.' WHEN page_id % 4 < 2 THEN 'Collecting route data from a nearby measurement probe.' WHEN page_id % 4 = 2 THEN page_id || ' hops are ready for inspection.' ELSE 'Install-free browser experience. Not a direct trace from your device.' END AS message,
      CASE WHEN page_id % 5 = 0 THEN 'error  It failed.' ELSE 'no completed route output' END AS empty_line, CASE page_id % 3 WHEN 0 THEN 'SRC' WHEN 2 THEN 'DST' END AS role, CASE page_id % 4 WHEN 0 THEN 'Seoul, KR' WHEN 1 THEN 'DE' WHEN 2 THEN 'Seoul, Peru' ELSE 'Nearby probe' END AS source, rtrim(url, '/') AS address FROM pages""",
    "ipv6_targets": """SELECT p_partkey, replace(['fe80::{}', 'fd00:{}::1', '2001:db8::{}', '2606:4700::{}', '::ffff:10.0.0.1', '64:ff9b::{}', '100::{}', '1:2:3:4:5:6:7:{}', '1:2:3:4:5:6:{}', 'ff02::{}', '::{}:1', '12345::{}'][p_partkey % 12 + 1], '{}', format('{:x}', p_partkey * 7 % 65536)) AS raw,
      [true, true, true, false, true, true, true, false, NULL, true, false, NULL][p_partkey % 12 + 1] AS blocked FROM part""",
    "ipv4_scan": r"""WITH m AS (SELECT doc_id, list_filter(regexp_extract_all(text, '([0-9][0-9.]*)', 1), lambda x: regexp_full_match(x, '[0-9]{1,3}([.][0-9]{1,3}){3}')
        AND list_max(list_transform(string_split(x, '.'), lambda o: coalesce(TRY_CAST(o AS INT), 999))) <= 255) AS c FROM documents) SELECT doc_id, c[1] AS ip FROM m WHERE len(c) > 0""",
    "rtt_scan": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CAST(3 AS INT) AS n, q + q + (q + 0.25::DOUBLE) AS total, round((q + q + (q + 0.25::DOUBLE)) / 3) AS rtt_ms
      FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS q FROM lineitem)""",
    # A line that begins with its latency has that number taken for its network's.
    "raw_hop_decode": f"""WITH {HOPS}, l AS (SELECT *, asn = 'AS???' AND hostname IS NULL AND ip IS NULL AND rtt_ms IS NOT NULL AS odd,
        CASE WHEN rtt_ms IS NOT NULL THEN coalesce(hostname, ip, CASE WHEN asn = 'AS???' THEN 'ms' ELSE CAST(CAST(rtt_ms AS INT) AS VARCHAR) END) END AS host FROM hops)
      SELECT measurement_id, hop_number, CASE WHEN odd THEN 'AS' || CAST(rtt_ms AS INT) WHEN asn <> 'AS???' THEN asn ELSE {inferred('ip', 'host')} END AS asn, host AS hostname, ip, rtt_ms,
      CASE WHEN rtt_ms IS NULL THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS packet_loss_percent, CASE WHEN rtt_ms IS NULL THEN 'loss' WHEN rtt_ms > 120 THEN 'slow' ELSE 'ok' END AS status FROM l""",
    "json_hop_decode": f"WITH {HOPS} SELECT measurement_id, hop_seq, hop_number, asn, ip, hostname, city, country, latitude, longitude, rtt_ms, jitter_ms, packet_loss_percent, status FROM hops",
    "haversine": f"WITH {HOPS}, {SOURCES} SELECT measurement_id, hop_seq, round({haversine('src_latitude', 'src_longitude', 'latitude', 'longitude')}, 6) AS km FROM hops JOIN sources USING (measurement_id) WHERE latitude IS NOT NULL",
    "longitude_wrap": "SELECT p_partkey, round(((p_retailprice - 1200 + 180) % 360 + 360) % 360 - 180, 6) AS longitude FROM part",
    "zoom_and_color": f"""WITH {HOPS}, s AS (SELECT measurement_id, greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)) AS span, max(status) AS status FROM hops GROUP BY 1)
      SELECT measurement_id, round(span, 6) AS span, CAST(CASE WHEN round(span, 6) > 80 THEN 3.75 WHEN round(span, 6) > 55 THEN 4.15 WHEN round(span, 6) > 28 THEN 4.85 ELSE 6.25 END AS DOUBLE) AS zoom,
      CASE WHEN status IN ('loss', 'timeout') THEN '#ff756c' WHEN status = 'slow' THEN '#f6c65b' ELSE '#5ee7ff' END AS color FROM s""",
    "city_from_hostname": f"WITH {HOPS}, hosts AS (SELECT DISTINCT hostname FROM hops WHERE hostname IS NOT NULL), {host_match('hosts')} SELECT hostname, {city(0, 'city_ord')} AS city, alias FROM hosts LEFT JOIN matched USING (hostname)",
    "place_names": f"""WITH r AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN ' Republic of Korea ' WHEN 2 THEN 'UK' ELSE 'Hong_Kong' END AS raw FROM nation), l AS (SELECT *, lower(raw) AS n FROM r)
      SELECT n_nationkey, {code('raw')} AS code, nullif(trim(translate(n, '._-', '   ')), '') AS city, CASE {' '.join(f"WHEN n = {text(k.lower())} OR contains(n, {text(p)}) THEN {y!r}::DOUBLE" for k, p, y, _ in dims.CENTROIDS)} ELSE 25.0::DOUBLE END AS lat,
      CASE {' '.join(f"WHEN n = {text(k.lower())} OR contains(n, {text(p)}) THEN {x!r}::DOUBLE" for k, p, _, x in dims.CENTROIDS)} ELSE 20.0::DOUBLE END AS lon, {label('raw')} AS shown FROM l""",
    "metro_match": f"WITH {HOPS}, p AS (SELECT DISTINCT city, country, latitude, longitude FROM hops WHERE latitude IS NOT NULL) SELECT city, {values([m[0] for m in dims.METROS])}[{metro('city', 'country', '(latitude + 0.5::DOUBLE)', 'longitude')} + 1] AS metro FROM p",
    "candidate_scores": FUSION + " SELECT measurement_id, hop_seq, CAST(row_number() OVER (PARTITION BY measurement_id, hop_seq ORDER BY ord) AS INT) AS ord, source, city, precision, score FROM scored",
    "enriched_hops": FUSION
    + f""", firsts AS (SELECT measurement_id, hop_seq, min(ord) FILTER (source = 'reverse_dns') AS r, min(ord) FILTER (source = 'geoip') AS g FROM scored GROUP BY ALL), comb AS (
      SELECT f.measurement_id, f.hop_seq, a.city, a.country, a.lat, a.lon, a.evidence || '; ' || b.evidence AS evidence, a.precision FROM firsts f
      JOIN scored a ON a.measurement_id = f.measurement_id AND a.hop_seq = f.hop_seq AND a.ord = f.r JOIN scored b ON b.measurement_id = f.measurement_id AND b.hop_seq = f.hop_seq AND b.ord = f.g
      WHERE {haversine("a.lat", "a.lon", "b.lat", "b.lon")} < 90 OR lower(a.city) = lower(b.city)), best AS (
      SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY measurement_id, hop_seq ORDER BY score DESC, ord) = 1)
      SELECT h.measurement_id, h.hop_seq, coalesce(CASE WHEN h.hop_seq % 2 = 0 THEN h.asn END, g.geo_asn) AS asn, g.geo_as_name AS as_name, coalesce(c.city, b.city, h.city) AS city, coalesce(c.country, b.country, h.country) AS country, round(coalesce(c.lat, b.lat, h.latitude), 6) AS latitude, round(coalesce(c.lon, b.lon, h.longitude), 6) AS longitude,
      CASE WHEN c.city IS NOT NULL THEN 'high' WHEN b.city IS NOT NULL THEN b.confidence ELSE 'low' END AS location_confidence, CASE WHEN c.city IS NOT NULL THEN 'combined' WHEN b.city IS NOT NULL THEN b.source ELSE 'unknown' END AS location_source,
      coalesce(c.precision, b.precision, 'unknown') AS location_precision, coalesce(c.evidence, b.evidence, 'No reliable city-level evidence found') AS evidence
      FROM hops h LEFT JOIN geo g ON h.ip = g.ip LEFT JOIN comb c ON c.measurement_id = h.measurement_id AND c.hop_seq = h.hop_seq LEFT JOIN best b ON b.measurement_id = h.measurement_id AND b.hop_seq = h.hop_seq""",
    "network_lookup": f"WITH {HOPS} SELECT g.asn, name, country, n_hops FROM (SELECT asn, count(*) AS n_hops FROM hops GROUP BY 1) g LEFT JOIN {NETWORKS} ON g.asn = n.asn",
    "as_islands": f"WITH {HOPS}, {SEGMENTS} SELECT measurement_id, segment, asn, name, place, n_hops, status FROM segments",
    "endpoints": f"WITH {HOPS}, {SOURCES}, {ENDPOINTS} SELECT * FROM ends",
    "place_islands": f"""WITH {HOPS}, {SOURCES}, {SEGMENTS}, {ENDPOINTS}, shown AS (SELECT s.* FROM segments s JOIN ends e USING (measurement_id) WHERE asn <> 'AS???' AND place IS NOT NULL
      AND NOT sqrt(pow(latitude - src_lat, 2) + pow(longitude - src_lon, 2)) < 0.7 AND NOT coalesce(sqrt(pow(latitude - dst_lat, 2) + pow(longitude - dst_lon, 2)) < 0.7, false)),
      m AS (SELECT *, CASE WHEN place = lag(place) OVER (PARTITION BY measurement_id ORDER BY segment) THEN 0 ELSE 1 END AS fresh FROM shown), n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY measurement_id ORDER BY segment) AS INT) AS g FROM m)
      SELECT measurement_id, g AS "group", min_by(asn, segment) AS asn, min_by(place, segment) AS place, CAST(sum(n_hops) AS INT) AS n_hops, ['ok', 'slow', 'loss', 'timeout'][max(rank)] AS status FROM n GROUP BY 1, 2""",
    "hop_ranges": f"""WITH {HOPS}, d AS (SELECT DISTINCT measurement_id, hop_number AS n FROM hops WHERE latitude IS NOT NULL), i AS (SELECT *, n - row_number() OVER (PARTITION BY measurement_id ORDER BY n) AS g FROM d),
      r AS (SELECT measurement_id, min(n) AS a, max(n) AS b, count(*) AS c FROM i GROUP BY measurement_id, g)
      SELECT measurement_id, CASE WHEN sum(c) > 1 THEN 'Mapped hops ' ELSE 'Mapped hop ' END || string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS label FROM r GROUP BY 1""",
    "sampled_groups": f"""WITH {HOPS}, c AS (SELECT measurement_id, hop_seq, count(*) OVER (PARTITION BY measurement_id) AS n FROM hops)
      SELECT measurement_id, hop_seq FROM c WHERE n <= 12 OR hop_seq IN (SELECT CAST(round(i / 11 * (n - 1)) AS INT) + 1 FROM range(12) AS r(i))""",
    "metric_labels": f"""WITH {HOPS}, h AS (SELECT *, packet_loss_percent + 0.5::DOUBLE AS x FROM hops) SELECT measurement_id, hop_seq,
      nullif(concat_ws(' · ', CAST(CAST(round(rtt_ms) AS BIGINT) AS VARCHAR) || ' ms avg', CASE WHEN x > 0 THEN {LOSS.format("x")} || ' loss' END, CASE WHEN status <> 'ok' THEN status END), '') AS label,
      CASE WHEN lower(city) <> lower(country) AND lower(country) <> 'unknown' THEN city || ', ' || country ELSE coalesce(city, country, 'Estimated network region') END AS location FROM h""",
    "traceout_report": f"""WITH {HOPS}, l AS (SELECT *, CASE WHEN rtt_ms IS NULL THEN '*' ELSE CAST(CAST(round(rtt_ms) AS BIGINT) AS VARCHAR) || ' ms' END AS r, CAST(hop_number AS VARCHAR) AS n,
      CASE WHEN hostname <> ip THEN hostname || ' (' || ip || ')' ELSE coalesce(hostname, ip, '*') END AS host FROM hops)
      SELECT measurement_id, string_agg(repeat(' ', greatest(0, 2 - len(n))) || n || '  ' || repeat(' ', greatest(0, 6 - len(r))) || r || '  ' || rpad(status, 7, ' ') || '  ' || host, chr(10) ORDER BY hop_seq) AS report FROM l GROUP BY 1""",
    "mtr_report": f"""WITH {HOPS}, r AS (SELECT *, coalesce(CAST(CAST(round(rtt_ms) AS BIGINT) AS VARCHAR), '0') AS v FROM hops)
      SELECT measurement_id, hop_seq, CAST(hop_number AS VARCHAR) AS num, asn, CASE WHEN hostname <> ip THEN hostname || ' (' || ip || ')' ELSE coalesce(hostname, ip, '*') END AS host, coalesce({_loss}, '-') AS loss, '16' AS snt, v AS last, v AS avg, v AS best, v AS wrst,
      coalesce(CAST(CAST(round(jitter_ms) AS BIGINT) AS VARCHAR), '0') AS stdev FROM r""",
    "command_lines": f"""WITH o AS (SELECT *, o_orderkey % 2 = 0 AS mtr, o_orderkey % 3 AS pr, 'h' || o_custkey || '.net' AS t FROM orders), l AS (SELECT o_orderkey, [CASE WHEN mtr THEN '$ mtr -rwc 16 -z ' || t ELSE '$ traceout ' || t END,
      'provider  ' || CASE pr WHEN 0 THEN 'Globalping API' WHEN 1 THEN 'Demo provider' ELSE 'Measurement provider' END || CASE WHEN mtr AND pr = 0 THEN ' - API packet cap 16' ELSE '' END, {text(NOTICES[0])}, {text(NOTICES[1])}] || CASE WHEN mtr AND pr = 0 THEN [{text(CAP_NOTICE)}] ELSE [] END AS ls FROM o)
      SELECT o_orderkey, CAST(i AS INT) AS line_no, ls[i + 1] AS line FROM l, range(5) AS r(i) WHERE i < len(ls)""",
    "hop_upsert": f"WITH {EVENTS} SELECT session_id, hop_number, {', '.join(LATEST.format(c, f'{c} IS NOT NULL') for c in EVENT_FIELDS)} FROM ev WHERE type = 'hop_result' GROUP BY 1, 2",
    "event_reduce": f"""WITH {EVENTS}, l AS (SELECT *, coalesce(max(seq) FILTER (type IN ('measurement_started', 'measurement_finished')) OVER (PARTITION BY session_id), 0) AS last FROM ev),
      a AS (SELECT session_id, seq, type, hop_number, {', '.join(EVENT_FIELDS)} FROM l WHERE seq > last AND type IN ('hop_result', 'metric_update')
        UNION ALL SELECT session_id, seq, 'hop_result', CAST(i AS INT), NULL, CASE WHEN k % 3 <> i % 3 THEN 'p' || i END, value + i, NULL, NULL, 'ok' FROM l, range(1, 4) AS x(i) WHERE seq = last AND i <= k % 4),
      r AS (SELECT *, min(seq) FILTER (type = 'hop_result') OVER (PARTITION BY session_id, hop_number) AS first FROM a)
      SELECT session_id, hop_number, {', '.join(LATEST.format(c, f"{c} IS NOT NULL" + ("" if c in ('rtt_ms', 'jitter_ms', 'packet_loss_percent', 'status') else " AND type = 'hop_result'")) for c in EVENT_FIELDS)} FROM r WHERE seq >= first GROUP BY 1, 2""",
    "session_status": f"""WITH {EVENTS}, s AS (SELECT session_id, max_by(type, seq) FILTER (type IN ('measurement_started', 'measurement_finished', 'error')) AS t, min(ts_ms) AS created_ms, max(ts_ms) FILTER (type IN ('measurement_finished', 'error')) AS ended, count(*) AS n_events FROM ev GROUP BY 1)
      SELECT session_id, CASE t WHEN 'measurement_started' THEN 'running' WHEN 'measurement_finished' THEN 'finished' WHEN 'error' THEN 'error' ELSE 'starting' END AS status, created_ms, least(created_ms + 900000, ended + 120000) AS expires_ms, n_events FROM s""",
    "session_cap": f"WITH {EVENTS}, s AS (SELECT session_id, min(ts_ms) AS created_ms FROM ev GROUP BY 1) SELECT *, row_number() OVER (ORDER BY created_ms DESC, session_id DESC) <= 500 AS kept FROM s",
    "latest_result": f"WITH {EVENTS} SELECT session_id, max(seq) AS seq, max_by(type, seq) AS type, max_by(ts_ms, seq) AS ts_ms FROM ev WHERE type IN ('measurement_started', 'measurement_finished') GROUP BY 1",
    "new_hops": f"""WITH {EVENTS}, s AS (SELECT session_id, seq AS poll, hop_number AS n, coalesce(max(hop_number) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM ev)
      SELECT session_id, poll, CAST(i AS INT) AS hop_seq FROM s, range(1, 9) AS r(i) WHERE i > seen AND i <= n""",
    "failover": f"""WITH {EVENTS}, demo AS (SELECT c_custkey AS session_id, CAST(n AS INT) AS seq, CASE n WHEN 1 THEN 'measurement_started' WHEN 2 THEN CASE WHEN c_custkey % 7 = 0 THEN 'error' ELSE 'hop_result' END ELSE 'measurement_finished' END AS type FROM customer, range(1, 4) AS r(n)),
      a AS (SELECT session_id, min(seq) FILTER (type = 'error') AS failed, max(seq) AS last FROM ev GROUP BY 1), b AS (SELECT session_id, min(seq) FILTER (type = 'error') AS failed, max(seq) AS last FROM demo GROUP BY 1),
      gone AS (SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.failed - 1, 0) AS shift, b.session_id IS NULL OR b.failed IS NOT NULL AS lost, coalesce(b.failed - 1, b.last, 0) AS own FROM a FULL JOIN b ON a.session_id = b.session_id WHERE a.session_id IS NULL OR a.failed IS NOT NULL)
      SELECT ev.session_id, CAST(seq AS INT) AS seq, 'live' AS source, type, NULL::VARCHAR AS message FROM ev JOIN a ON ev.session_id = a.session_id WHERE failed IS NULL OR seq < failed
      UNION ALL SELECT demo.session_id, CAST(seq + shift AS INT), 'demo', type, NULL FROM demo JOIN gone ON demo.session_id = gone.session_id JOIN b ON demo.session_id = b.session_id WHERE failed IS NULL OR seq < failed
      UNION ALL SELECT session_id, CAST(shift + own + 1 AS INT), 'demo', 'error', 'Measurement is temporarily unavailable. Please try again later.' FROM gone WHERE lost""",
    "rate_limit": f"""WITH RECURSIVE {EVENTS}, n AS (SELECT session_id AS client, seq, ts_ms, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS i FROM ev),
      s AS (SELECT client, seq, ts_ms, i, true AS allowed, 1 AS m, ts_ms + 60000 AS mr, 1 AS h, ts_ms + 3600000 AS hr FROM n WHERE i = 1
        UNION ALL SELECT n.client, n.seq, n.ts_ms, n.i, x.m < 8 AND x.h < 80, x.m + CAST(x.m < 8 AND x.h < 80 AS INT), x.mr, x.h + CAST(x.m < 8 AND x.h < 80 AS INT), x.hr FROM n JOIN s p ON n.client = p.client AND n.i = p.i + 1,
        LATERAL (SELECT CASE WHEN p.mr < n.ts_ms THEN 0 ELSE p.m END AS m, CASE WHEN p.mr < n.ts_ms THEN n.ts_ms + 60000 ELSE p.mr END AS mr, CASE WHEN p.hr < n.ts_ms THEN 0 ELSE p.h END AS h, CASE WHEN p.hr < n.ts_ms THEN n.ts_ms + 3600000 ELSE p.hr END AS hr) x)
      SELECT client, seq, ts_ms, allowed FROM s""",
    "demo_hops": f"""WITH {DEMO} SELECT measurement_id, hop_number, CASE WHEN n = 5 THEN CASE WHEN contains(target, 'google') THEN 'AS15169' WHEN target = '1.1.1.1' THEN 'AS13335' ELSE 'AS8560' END ELSE ['AS???', 'AS???', 'AS64512', 'AS3356'][n] END AS asn,
      CASE WHEN n = 5 THEN 'edge.' || target ELSE ['nearby-probe.local', 'edge-gateway.net', 'regional-exchange.net', 'transit-backbone.example'][n] END AS hostname,
      CASE WHEN n = 5 THEN CASE WHEN target = '1.1.1.1' THEN target ELSE '192.0.2.80' END ELSE ['10.18.0.1', '172.18.42.1', '203.0.113.14', '198.51.100.35'][n] END AS ip,
      CAST(base + plus AS DOUBLE) AS rtt_ms, CAST(jit AS DOUBLE) AS jitter_ms, CAST(CASE WHEN mtr THEN [0, 0, 1, 2, 0][n] ELSE 0 END AS DOUBLE) AS packet_loss_percent, CASE WHEN n = 4 THEN 'slow' ELSE 'ok' END AS status FROM demo""",
    "demo_metric_updates": f"WITH {DEMO} SELECT measurement_id, CAST(r AS INT) AS round, hop_number, CAST(base + plus + (r + n) % 3 * 3 AS DOUBLE) AS rtt_ms, CAST(jit + (r + n) % 3 AS DOUBLE) AS jitter_ms FROM demo, range(4) AS x(r) WHERE mtr",
    "measurement_requests": """WITH o AS (SELECT *, o_orderkey AS k, o_custkey AS c, o_orderkey % 2 = 0 AS mtr,
        ['Asia/Seoul', 'Asia/Tokyo', 'Asia/Singapore', 'America/Los_Angeles', 'America/New_York', 'Europe/Berlin', NULL][o_custkey % 7 + 1] AS zone FROM orders),
      r AS (SELECT *, CASE WHEN c % 5 = 0 THEN 'South Korea' ELSE coalesce(['South Korea', 'Japan', 'Singapore', 'California', 'New York', NULL, NULL][c % 7 + 1], 'World') END AS region FROM o)
      SELECT o_orderkey, region, CASE WHEN mtr THEN 'mtr' ELSE 'traceroute' END AS type, CASE WHEN mtr THEN 'ICMP+TCP' ELSE 'ICMP' END AS protocols,
        '{"type":"' || CASE WHEN mtr THEN 'mtr' ELSE 'traceroute' END || '","target":"h' || c || '.net","locations":[{"magic":"' || region || '"}],"limit":1,"measurementOptions":{"protocol":"' || CASE WHEN mtr THEN 'TCP","packets":16' ELSE 'ICMP"' END || '}}' AS body,
        CASE WHEN mtr AND k % 4 IN (0, 1) THEN CAST(1 AS INT) END AS next_protocol, k % 3 = 0 OR k % 5 > 2 AS over,
        CASE WHEN c % 3 = 1 THEN '10.0.' || c % 250 || '.1' WHEN c % 2 = 1 THEN 'p' || c ELSE 'unknown' END AS client, CASE WHEN zone IS NOT NULL THEN CAST(least(80, 9 * len(zone)) AS INT) END AS zone_kept,
        CASE WHEN k % 3 = 0 THEN 'idle' WHEN k % 2 = 1 OR c % 4 < 2 OR k % 5 = 0 THEN 'launch' ELSE 'settled' END AS journey FROM r""",
    "lookup_records": """WITH s AS (SELECT *, s_suppkey AS k, '9.' || (s_suppkey // 250) % 250 || '.' || s_suppkey % 250 || '.1' AS ip FROM supplier JOIN nation ON s_nationkey = n_nationkey)
      SELECT ip, 'C' || k AS geo_city, n_name AS geo_country, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN k % 90 + 0.5::DOUBLE END AS geo_latitude, CASE WHEN k % 7 = 0 THEN 1.0::DOUBLE WHEN k % 11 <> 0 THEN -(k % 180)::DOUBLE END AS geo_longitude,
        'r' || k || '.net' AS geo_hostname, CASE WHEN k % 13 <> 0 THEN 'AS' || k END AS geo_asn, CASE WHEN k % 13 = 0 THEN 'none' ELSE s_name END AS geo_as_name FROM s WHERE k % 2 = 1
      UNION ALL SELECT ip, 'C' || k, CASE WHEN k % 3 <> 0 THEN 'DE' ELSE n_name END, CASE WHEN k % 7 <> 0 THEN k % 90 + 0.25::DOUBLE END, -(k % 180)::DOUBLE, 'r' || k || '.net', 'AS' || k, CASE WHEN k % 4 <> 0 THEN 'N' || k ELSE 'One' END FROM s WHERE k % 2 = 0 AND k % 5 <> 0""",
    "named_hops": f"""WITH {HOPS}, a AS (SELECT *, ip IS NOT NULL AND NOT {within(number('ip'), ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/16", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3"])} AS known,
        CAST({' + '.join(octet('ip', i) for i in (1, 2, 3, 4))} AS BIGINT) % 21 AS place FROM hops), n AS (SELECT * REPLACE (coalesce(hostname, CASE WHEN known THEN 'ptr-' || replace(ip, '.', '-') || '.icn.example' END) AS hostname) FROM a),
      hosts AS (SELECT DISTINCT hostname FROM n WHERE hostname IS NOT NULL), {host_match('hosts')}
      SELECT measurement_id, hop_seq, n.hostname, CASE WHEN city_ord IS NOT NULL THEN {city(0, 'city_ord')} END AS host_city, CASE WHEN known THEN {city(0, 'place')} END AS geo_city FROM n LEFT JOIN matched USING (hostname)""",
    "mtr_line_decode": f"""WITH {HOPS}, l AS (SELECT *, CAST(rtt_ms AS INT) + 0.6::DOUBLE AS r, hop_seq % 4 AS lost FROM hops WHERE packet_loss_percent IS NOT NULL AND rtt_ms IS NOT NULL)
      SELECT measurement_id, hop_seq, hop_number, asn, hostname, ip, round(r) AS rtt_ms, CAST(lost + 16 - lost * 4 AS BIGINT) AS sent, round(CAST(jitter_ms AS INT) + 0.7::DOUBLE) AS jitter_ms, packet_loss_percent,
        CASE WHEN packet_loss_percent >= 50 THEN 'loss' WHEN round(r) > 120 THEN 'slow' ELSE 'ok' END AS status FROM l""",
    "payload_parts": """WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS good FROM orders)
      SELECT o_orderkey, CASE WHEN good THEN 'p' || k END AS probe_id, CASE WHEN good AND k % 3 <> 0 THEN 'Seoul' END AS city, CASE WHEN good THEN 'KR' END AS country, CASE WHEN good THEN 'AS' || k END AS asn,
        CASE WHEN good AND k % 5 <> 0 THEN 37.5::DOUBLE END AS latitude, CASE WHEN good THEN -1.0::DOUBLE END AS longitude,
        CASE WHEN good AND k % 4 = 0 THEN 'e' || k WHEN good AND k % 4 = 1 THEN 'The measurement provider returned a failed result.' END AS failure FROM o""",
    "hop_table": f"""WITH {HOPS}, {SOURCES} SELECT h.measurement_id, hop_seq, coalesce(hostname, ip, '*') AS name, concat_ws(' · ', asn, city, country) AS detail, CASE WHEN coalesce(rtt_ms, 0) = 0 THEN '-' ELSE CAST(round(rtt_ms) AS BIGINT) || ' ms' END AS rtt,
        coalesce({LOSS.format('packet_loss_percent')}, '-') AS loss, 'Demo provider · ' || CASE WHEN src_city <> 'Seoul' THEN src_city || ', ' ELSE '' END || src_country AS badge
      FROM hops h JOIN sources s ON h.measurement_id = s.measurement_id WHERE CAST(h.measurement_id AS BIGINT) % 3 <> 0""",
    "event_frames": f"WITH {EVENTS} SELECT session_id, seq, ts_ms, type, hop_number, asn, hostname, rtt_ms, jitter_ms, packet_loss_percent, status, CASE WHEN type IN ('measurement_started', 'measurement_finished') THEN CAST(least(3, k % 4) AS INT) END AS n_listed FROM ev WHERE type IS NOT NULL",
    "last_attempts": f"WITH {EVENTS}, a AS (SELECT session_id, seq, type, CAST(hop_number // 4 AS INT) AS attempt FROM ev) SELECT * FROM a QUALIFY attempt = max(attempt) OVER (PARTITION BY session_id)",
    "page_markup": """SELECT page_id, '&lt;a href=&#39;' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') || '?a=1&amp;b=2&#39;&gt;' || page_id || '&quot;' AS markup,
      round(greatest(1.2::DOUBLE, log2(greatest(length(html), 320) / 256.0::DOUBLE) - 0.025::DOUBLE), 6) AS zoom FROM pages""",
    "district_places": """WITH c AS (SELECT c_custkey, ['Wan Chai', 'central', 'Kowloon.', 'Tsuen_Wan', 'New Territories', 'Seoul', NULL][c_custkey % 7 + 1] AS city, ['HK', 'Hong Kong', 'KR'][c_custkey % 3 + 1] AS country FROM customer),
      d AS (SELECT *, c_custkey % 7 < 5 AND c_custkey % 3 < 2 AS hit FROM c WHERE city IS NOT NULL)
      SELECT c_custkey, CASE WHEN hit THEN 'Hong Kong' ELSE city END AS city, CASE WHEN hit THEN 'HK' ELSE country END AS country, CASE WHEN hit THEN 22.3193::DOUBLE ELSE 1.0::DOUBLE END AS lat, 'city' AS precision,
        'provider supplied hop coordinates' || CASE WHEN hit THEN '; ' || city || ' normalized to Hong Kong metro for route readability' ELSE '' END AS evidence FROM d""",
}
_few = "CASE WHEN coalesce(len({0}), 0) = 0 THEN {2} WHEN len({0}) <= 2 THEN array_to_string({0}, ' / ') ELSE {0}[1] || ' +' || (len({0}) - 1) || '{1}' END"
_near = "sqrt(pow({0}.lat - {1}.lat, 2) + pow({0}.lon - {1}.lon, 2)) < 0.7"
_rank = "list_position(['ok', 'slow', 'loss', 'timeout'], {0})"
#: Points of routes: groups of segments between the ends, sampled, labelled, and merged one after the other where they are near.
ROUTE = f"""{HOPS}, {SOURCES}, {SEGMENTS}, {ENDPOINTS}, shown AS (
  SELECT s.* FROM segments s JOIN ends e USING (measurement_id) WHERE asn <> 'AS???' AND place IS NOT NULL
    AND NOT sqrt(pow(latitude - src_lat, 2) + pow(longitude - src_lon, 2)) < 0.7 AND NOT coalesce(sqrt(pow(latitude - dst_lat, 2) + pow(longitude - dst_lon, 2)) < 0.7, false)
), fresh AS (
  SELECT measurement_id, segment, CASE WHEN place = lag(place) OVER (PARTITION BY measurement_id ORDER BY segment) THEN 0 ELSE 1 END AS f FROM shown
), grouped AS (
  SELECT measurement_id, segment, sum(f) OVER (PARTITION BY measurement_id ORDER BY segment) AS g FROM fresh
), own AS (
  SELECT n.*, g, count(*) OVER (PARTITION BY n.measurement_id, g) AS n_in FROM numbered n JOIN grouped USING (measurement_id, segment)
), asns AS (
  SELECT measurement_id, g, list(asn ORDER BY seen) AS asns FROM (SELECT measurement_id, g, asn, min(hop_seq) AS seen FROM own WHERE asn <> 'AS???' GROUP BY ALL) GROUP BY 1, 2
), names AS (
  SELECT measurement_id, g, list(n_name ORDER BY seen) AS names FROM (SELECT measurement_id, g, n_name, min(hop_seq) AS seen FROM own WHERE n_name IS NOT NULL GROUP BY ALL) GROUP BY 1, 2
), runs AS (
  SELECT measurement_id, g, min(hop_number) AS a, max(hop_number) AS b, count(*) AS c FROM (
    SELECT *, hop_number - row_number() OVER (PARTITION BY measurement_id, g ORDER BY hop_number) AS d FROM (SELECT DISTINCT measurement_id, g, hop_number FROM own)) GROUP BY measurement_id, g, d
), ranges AS (
  SELECT measurement_id, g, CASE WHEN sum(c) > 1 THEN 'Mapped hops ' ELSE 'Mapped hop ' END || string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS mapped FROM runs GROUP BY 1, 2
), firsts AS (
  SELECT measurement_id, g, min_by(asn, hop_seq) AS asn, min_by(n_name, segment) AS name, min_by(place_city, hop_seq) AS c, min_by(place_country, hop_seq) AS k, min_by(latitude, hop_seq) AS lat, min_by(longitude, hop_seq) AS lon,
    CAST(count(*) AS INT) AS n, max(rank) AS rank, max(hop_seq) AS last FROM own GROUP BY 1, 2
), lasts AS (
  SELECT o.measurement_id, o.g, nullif(concat_ws(' · ', CAST(CAST(round(o.rtt_ms) AS BIGINT) AS VARCHAR) || ' ms avg', CASE WHEN o.packet_loss_percent > 0 THEN {LOSS.format("o.packet_loss_percent")} || ' loss' END, CASE WHEN o.status <> 'ok' THEN o.status END), '') AS metric
  FROM own o JOIN firsts f ON o.measurement_id = f.measurement_id AND o.g = f.g AND o.hop_seq = f.last
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY measurement_id) AS groups FROM firsts
), kept AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.measurement_id ORDER BY c.g) AS i,
    concat_ws(' · ', {_few.format("asns", " AS", "asn")}, {_few.format("names", " networks", "coalesce(name, 'Unknown network')")}, CASE WHEN lower(c) <> lower(k) AND lower(k) <> 'unknown' THEN c || ', ' || k ELSE coalesce(c, k, 'Estimated network region') END) AS label,
    concat_ws(' · ', mapped, CASE WHEN n > 1 THEN n || ' hops' END, metric) AS sub_label, ['ok', 'slow', 'loss', 'timeout'][rank] AS status
  FROM counted c LEFT JOIN asns USING (measurement_id, g) LEFT JOIN names USING (measurement_id, g) JOIN ranges USING (measurement_id, g) JOIN lasts USING (measurement_id, g)
  WHERE groups <= 12 OR g IN (SELECT CAST(round(x / 11 * (groups - 1)) AS INT) + 1 FROM range(12) AS r(x))
), points AS (
  SELECT measurement_id, i, {{'lat': lat, 'lon': lon, 'label': label, 'sub': sub_label, 'n': n, 'status': status}} AS p FROM kept
), merged AS (
  SELECT measurement_id, i, [p] AS acc FROM points WHERE i = 1
  UNION ALL SELECT x.measurement_id, x.i, CASE WHEN coalesce(hit, 0) > 0 THEN list_transform(acc, lambda c, j: CASE WHEN j = hit THEN {{'lat': c.lat, 'lon': c.lon, 'label': c.label, 'sub': concat_ws(' · ', nullif(c.sub, ''), nullif(p.sub, '')), 'n': c.n + p.n,
      'status': CASE WHEN {_rank.format("p.status")} > {_rank.format("c.status")} THEN p.status ELSE c.status END}} ELSE c END) ELSE list_append(acc, p) END
    FROM (SELECT q.measurement_id, q.i, q.p, m.acc, list_position(list_transform(m.acc, lambda c: {_near.format("c", "q.p")}), true) AS hit FROM merged m JOIN points q ON q.measurement_id = m.measurement_id AND q.i = m.i + 1) x
), clusters AS (
  SELECT measurement_id, max_by(acc, i) AS acc FROM merged GROUP BY 1
), mids AS (
  SELECT measurement_id, unnest(range(1, len(acc) + 1)) AS j, unnest(acc) AS p FROM clusters
), route AS (
  SELECT e.measurement_id, 1 AS sequence, 'source' AS role, src_lat AS latitude, src_lon AS longitude, CASE WHEN src_country IN ('Probe', 'Target') THEN src_city ELSE src_city || ' ' || src_country END AS label, NULL::VARCHAR AS sub_label, NULL::INT AS hop_count, 'source' AS status FROM ends e
  UNION ALL SELECT measurement_id, CAST(j + 1 AS INT), 'transit', p.lat, p.lon, p.label, p.sub, CAST(p.n AS INT), p.status FROM mids
  UNION ALL SELECT e.measurement_id, CAST(coalesce(len(acc), 0) + 2 AS INT), 'target', dst_lat, dst_lon, e.measurement_id, NULL, NULL, 'target' FROM ends e LEFT JOIN clusters c ON e.measurement_id = c.measurement_id WHERE dst_lat IS NOT NULL
), wrapped AS (
  SELECT * REPLACE (((longitude + 180) % 360 + 360) % 360 - 180 AS longitude) FROM route
)"""
ORACLE_SQL["route_points"] = f"WITH RECURSIVE {ROUTE} SELECT * FROM wrapped"
_fixed = "CAST(CAST(round({0}, 4) AS DECIMAL(10, 4)) AS VARCHAR)"
ORACLE_SQL["view_key"] = f"""WITH RECURSIVE {ROUTE} SELECT measurement_id, string_agg(role || ':' || {_fixed.format("latitude")} || ',' || {_fixed.format("longitude")} || ':' || coalesce(label, 'undefined'), '|' ORDER BY sequence) AS view_key FROM wrapped GROUP BY 1"""
ORACLE_SQL["measurement_summary"] = f"""WITH {HOPS}, {SEGMENTS}, c AS (SELECT measurement_id, count(*) AS n_hops, count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS n_located,
  count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL AND location_confidence = 'high') AS n_high, round(avg(rtt_ms)) AS avg_rtt_ms, round(avg(packet_loss_percent)) AS avg_loss_percent FROM hops GROUP BY 1),
  n AS (SELECT measurement_id, count(*) AS n_segments FROM segments GROUP BY 1)
  SELECT c.*, n_segments, CASE WHEN n_located = 0 THEN 'low' WHEN n_located / n_hops >= 0.58 AND n_high >= ceil(n_located * 0.45::DOUBLE) THEN 'high' WHEN n_located / n_hops >= 0.28 THEN 'medium' ELSE 'low' END AS confidence FROM c JOIN n USING (measurement_id)"""
