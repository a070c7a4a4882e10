"""Measurements to hops: status, raw text, JSON of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import text as t
from pathloom.functions.frames import worked_out
from pathloom.functions.net import inferred_asn


def hop_status(rtt: Column, loss: Column) -> Column:
    return F.when(loss >= 50, "loss").when(rtt.isNull(), "timeout").when(rtt > 120, "slow").otherwise("ok")


def mean_rtt(values: Column) -> Column:
    """The rounded mean of an array; null if empty."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, F.round(total / F.size(values)))


def raw_lines(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(…, line_no, line) of the text column's lines, trimmed, without blank ones."""
    out = raw.select("*", F.posexplode(F.split(column, "\n", -1)).alias("line_no", "__line"))
    return worked_out(out, {"line": t.trimmed(F.col("__line"))}).drop("__line").where(F.col("line") != "")


HOP_LINE = r"^([0-9]+)[.)]?\s+(.+)$"


def raw_hops(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines to hops; lines that aren't hops go. All other columns stay."""
    return _told(lines.where(F.col(line).rlike(HOP_LINE)), line)


#: What a hop's line tells.
TOLD = ("hop_number", "ip", "hostname", "rtt_ms", "sent", "jitter_ms", "packet_loss_percent", "asn", "last_ms", "status")


def _told(lines: DataFrame, line: str) -> DataFrame:
    """lines, which are hops or null, with columns TOLD."""
    # Each step's columns are used more than once by the next.
    out = worked_out(lines, {"hop_number": F.regexp_extract(line, HOP_LINE, 1).try_cast("int"), "rest": F.regexp_extract(line, HOP_LINE, 2)})
    out = worked_out(out, {"tokens": t.words(F.col("rest"))}).withColumn("own_asn", t.stated_asn(F.get("tokens", F.lit(0))))
    out = out.withColumn("tokens", F.when(F.col("own_asn").isNotNull(), F.slice("tokens", 2, F.greatest(F.size("tokens"), F.lit(1)))).otherwise(F.col("tokens")))
    stars = F.size(F.filter("tokens", lambda x: x == "*"))
    out = out.withColumn("waiting", F.contains(F.col("rest"), F.lit("(waiting for reply)")) | (stars >= 2))
    mask = F.transform("tokens", lambda x: F.endswith(x, F.lit("%")) & t.is_decimal(F.substring(x, F.lit(1), F.length(x) - 1)))
    out = out.withColumn("at", F.array_position(mask, True).cast("int"))
    out = out.withColumn("told", F.when(F.col("at") > 0, F.transform(F.slice("tokens", F.greatest(F.col("at"), F.lit(1)), F.lit(6)), t.number_of_word)))
    after = lambda i: F.get("told", F.lit(i))
    dropped, received = after(1), after(2)
    first = F.get("tokens", F.lit(0))
    out = out.withColumns({
        "ip": t.ipv4_in(F.col("rest")),
        "hostname": F.when(~F.col("waiting") & ~first.isin("*", "???"), first),
        "rtt_ms": F.when(after(3).isNotNull(), F.round(after(3))).otherwise(mean_rtt(t.rtt_values(F.col("rest")))),
        "sent": F.when(dropped.isNotNull() & received.isNotNull(), dropped + received).otherwise(dropped),
        "jitter_ms": F.round(F.coalesce(after(5), after(4))),
        "packet_loss_percent": F.coalesce(after(0), F.when(F.col("waiting") | F.contains(F.col("rest"), F.lit("*")), 100.0).otherwise(0.0)),
    })
    out = out.withColumns({
        "asn": F.coalesce("own_asn", inferred_asn(F.col("ip"), F.col("hostname"))), "last_ms": F.col("rtt_ms"),
        "sent": F.when(F.col("sent") != 0, F.col("sent").cast("long")), "status": hop_status(F.col("rtt_ms"), F.col("packet_loss_percent")),
    })
    return out.drop("rest", "tokens", "own_asn", "waiting", "at", "told")


def _get(v: str, path: str) -> str:
    return f"try_variant_get({v}, '$.{path}', 'variant')"


def _number(v: str) -> str:
    """A finite number, from a number only."""
    return f"case when rlike(schema_of_variant({v}), '^(BIGINT|DOUBLE|FLOAT|DECIMAL)') then try_variant_get({v}, '$', 'double') end"


_SPACE = r"' \t\n\r\u000b\u000c'"


def _string(v: str) -> str:
    """A text that isn't blank, trimmed, from a text only."""
    return f"case when schema_of_variant({v}) = 'STRING' then nullif(trim(both {_SPACE} from try_variant_get({v}, '$', 'string')), '') end"


def _first(kind, *values: str) -> str:
    return f"coalesce({', '.join(kind(v) for v in values)}, null)"


def _plain_asn(v: str) -> str:
    """A network number from a positive number, a text with "AS", digits, or the mark of an unknown network."""
    said = _string(v)
    return (
        f"case when schema_of_variant({v}) = 'STRING' then case when upper({said}) = 'AS???' then 'AS???' else coalesce("
        rf"concat('AS', nullif(regexp_extract({said}, '(?<![A-Za-z0-9])[Aa][Ss]\\s*([0-9]+)', 1), '')), case when {said} rlike '^[0-9]{{1,10}}$' then concat('AS', {said}) end) end"
        f" when {_number(v)} > 0 then concat('AS', cast(cast(floor({_number(v)}) as decimal(38, 0)) as string)) end"
    )


def _inner(v: str) -> str:
    """What an object says of a network: the first of asn, number, id, value that is there and isn't null."""
    return f"case when {v} is not null then coalesce(" + ", ".join(f"case when not is_variant_null({_get(v, k)}) then {_get(v, k)} end" for k in ("asn", "number", "id", "value")) + ") end"


# The keys of a hop by field, in the order in which they are asked.
ASN_KEYS = ("asn", "as", "asNumber", "autonomousSystem", "resolvedAsn", "resolvedASN")
AS_NAME_KEYS = ("asName", "networkName", "autonomousSystemName", "owner")
INNER_NAME_KEYS = ("name", "description", "owner")
PLACE_OBJECTS = ("location", "geo", "geoip", "geolocation")
CITY_KEYS, PLACE_CITY_KEYS = ("city", "resolvedCity"), ("city", "name")
COUNTRY_KEYS, PLACE_COUNTRY_KEYS = ("country", "countryCode", "resolvedCountry"), ("country", "countryCode", "country_code")
LATITUDE_KEYS, LONGITUDE_KEYS = ("latitude", "lat"), ("longitude", "lon", "lng")
RTT_KEYS = ("rtt", "avg", "mean", "latency", "last")
ADDRESS_KEYS, HOST_KEYS = ("resolvedAddress", "ip", "address"), ("resolvedHostname", "hostname", "host", "name")
LISTED_ADDRESS_KEYS, LISTED_HOST_KEYS = ("ip", "resolvedAddress", "address"), ("hostname", "resolvedHostname", "host", "name")
SENT_KEYS, LAST_KEYS = ("sent", "snt", "total", "count", "packets"), ("last", "lastRtt", "current")
BEST_KEYS, WORST_KEYS = ("best", "min", "minimum"), ("worst", "max", "maximum")
OBJECT_KEYS = (*PLACE_OBJECTS, "stats", "network", "timings")  # asked for as objects only
STATS_JITTER_KEYS, JITTER_KEYS = ("jitter", "jitterAvg", "stdev", "stddev"), ("jitter", "jAvg", "stDev", "stdev", "stddev")


def _bound(v: str, name: str, body: str) -> str:
    """body with v bound to a name, so that it is worked out once."""
    return f"get(transform(array({v}), {name} -> {body}), 0)"


def _read(v: str) -> str:
    """A text as (raw, null), a number as (null, num), anything else as null. Each value is looked at once, here."""
    get = lambda kind: f"try_variant_get({v}, '$', '{kind}')"
    return (
        f"case when schema_of_variant({v}) = 'STRING' then named_struct('raw', {get('string')}, 'num', cast(null as double))"
        f" when rlike(schema_of_variant({v}), '^(BIGINT|DOUBLE|FLOAT|DECIMAL)') then named_struct('raw', cast(null as string), 'num', {get('double')}) end"
    )


def _read_string(r: str) -> str:
    """_string of what _read has read."""
    return f"nullif(trim(both {_SPACE} from {r}.raw), '')"


def _read_number(r: str) -> str:
    return f"{r}.num"


def _read_lenient(r: str) -> str:
    text = rf"trim(both {_SPACE} from regexp_replace({r}.raw, '%\\z', ''))"
    read = r"case when t = '' then 0D when t rlike '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' then try_cast(t as double) end"
    return f"case when {r}.raw is not null then {_bound(text, 't', read)} else {r}.num end"


def _read_asn(r: str) -> str:
    """_plain_asn of what _read has read."""
    said = (
        "case when upper(t) = 'AS???' then 'AS???' else coalesce("
        r"concat('AS', nullif(regexp_extract(t, '(?<![A-Za-z0-9])[Aa][Ss]\\s*([0-9]+)', 1), '')), case when t rlike '^[0-9]{1,10}$' then concat('AS', t) end) end"
    )
    return f"case when {r}.raw is not null then {_bound(_read_string(r), 't', said)} when {r}.num > 0 then concat('AS', cast(cast(floor({r}.num) as decimal(38, 0)) as string)) end"


def _said_within(v: str, m: str) -> str:
    """_inner of a value, whose object is bound to the name m."""
    there = ", ".join(f"case when not is_variant_null({m}['{k}']) then {m}['{k}'] end" for k in ("asn", "number", "id", "value"))
    return _bound(f"try_variant_get({v}, '$', 'map<string, variant>')", m, f"coalesce({there})")


class _Record:
    """The object that lies at one of some paths of a hop, the first that is one: its values, and what _read says of each."""

    def __init__(self, name: str, *paths: str):
        self.name, self.paths = name, paths

    def __call__(self, *keys: str) -> list[str]:
        return [f"{self.name}_read['{k}']" for k in keys]

    def values(self, *keys: str) -> list[str]:
        return [f"{self.name}['{k}']" for k in keys]

    def object(self) -> Column:
        return F.expr("coalesce(" + ", ".join(f"try_variant_get(h, '{p}', 'map<string, variant>')" for p in self.paths) + ", null)")

    def read(self) -> Column:
        objects = ", ".join(f"'{k}'" for k in OBJECT_KEYS)
        return F.expr(f"transform_values({self.name}, (k, x) -> case when k in ({objects}) then null else {_read('x')} end)")


def json_hops(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Hops of JSON payloads, one row each; the other columns stay.

    A payload's result, if it is an object, stands for it. Its hops come from a non-empty array hops, else from an array
    result, else from the text rawOutput, else there are none. Fields are the first of several keys that has the right kind;
    of the places within a hop the first that is an object counts alone.
    """
    keep = [c for c in payloads.columns if c != column]
    # Each step is worked out once a payload: filters on what a later one reads don't parse the text again.
    v = worked_out(payloads, {"parsed": F.try_parse_json(column)}).drop(column)
    # Any object reads as a struct, whatever it holds. Its parts are copied once, from where they lie.
    v = worked_out(v, {"at": F.expr("if(try_variant_get(parsed, '$.result', 'struct<hops: boolean>') is null, 0, 1)")})
    part = lambda key, kind: F.expr(f"if(at = 1, try_variant_get(parsed, '$.result.{key}', '{kind}'), try_variant_get(parsed, '$.{key}', '{kind}'))")
    v = worked_out(v, {"hops": part("hops", "array<variant>"), "results": part("result", "array<variant>"), "raw": part("rawOutput", "variant")}).drop("parsed", "at")
    structured = F.coalesce(F.size("hops"), F.lit(0)) > 0
    v = v.withColumn("branch", F.when(structured, 1).when(F.col("results").isNotNull(), 2).otherwise(3))
    # Objects and lines come from one pass over the payloads; a row has one of both.
    text = "case when schema_of_variant(raw) = 'STRING' then try_variant_get(raw, '$', 'string') end"
    objects = "transform(if(branch = 1, hops, results), (x, i) -> struct(i, x as h, cast(null as string) as line))"
    lines = rf"transform(split({text}, '\\n', -1), (x, i) -> struct(i, cast(null as variant) as h, x as line))"
    rows = v.select(*keep, "branch", F.inline(F.expr(f"if(branch < 3, {objects}, {lines})")))
    rows = rows.withColumn("line", t.trimmed(F.col("line"))).where((F.col("branch") < 3) | F.col("line").rlike(HOP_LINE))
    rows = rows.withColumnRenamed("line", "__line")
    own = [F.col(c) for c in rows.columns]
    rows = _told(rows, "__line").select(*own, F.struct(*TOLD).alias("told")).drop("__line")

    # Each object is read once, then each of its values once, then the fields are picked from what they said.
    hop, stats, network, system = _Record("hop", "$"), _Record("stats", "$.stats"), _Record("network", "$.network"), _Record("system", "$.as", "$.autonomousSystem")
    place = _Record("place", *(f"$.{k}" for k in PLACE_OBJECTS))
    # What may name the network is itself, or what an object there says of it, two levels deep.
    def names_it(record: _Record, key: str) -> str:
        (read,), (value,) = record(key), record.values(key)
        levels = _bound(_said_within(value, "m"), "y", f"array(y, {_said_within('y', 'n')})")
        deeper = f"get(filter(transform(transform({levels}, x -> {_read('x')}), r -> {_read_asn('r')}), a -> a is not null), 0)"
        return f"case when {read} is not null then {_read_asn(read)} when {value} is not null then {deeper} end"

    named = [(hop, k) for k in ASN_KEYS] + [(network, k) for k in ("asn", "number")] + [(system, k) for k in ("asn", "number", "id")]
    asn = f"coalesce({', '.join(names_it(*x) for x in named)})"
    pick = lambda one, two: f"if(branch = 1, {one}, {two})"
    both = lambda keys: pick(_first(_read_lenient, *stats(*keys)), _first(_read_lenient, *hop(*keys)))
    mean = "case when size(rtts) > 0 then aggregate(rtts, 0D, (a, x) -> a + x) / size(rtts) end"
    fields = {
        "hop_number": pick("i + 1", f"coalesce(cast({_read_number(hop('hop')[0])} as int), i + 1)"), "asn": asn,
        "as_name": _first(_read_string, *hop(*AS_NAME_KEYS), *network(*INNER_NAME_KEYS), *system(*INNER_NAME_KEYS)),
        "ip": pick(_first(_read_string, *hop(*ADDRESS_KEYS)), _first(_read_string, *hop(*LISTED_ADDRESS_KEYS))),
        "hostname": pick(_first(_read_string, *hop(*HOST_KEYS)), _first(_read_string, *hop(*LISTED_HOST_KEYS))),
        "city": _first(_read_string, *hop(*CITY_KEYS), *place(*PLACE_CITY_KEYS)), "country": _first(_read_string, *hop(*COUNTRY_KEYS), *place(*PLACE_COUNTRY_KEYS)),
        "latitude": _first(_read_lenient, *hop(*LATITUDE_KEYS), *place(*LATITUDE_KEYS)), "longitude": _first(_read_lenient, *hop(*LONGITUDE_KEYS), *place(*LONGITUDE_KEYS)),
        "rtt_ms": f"round(coalesce({_first(_read_number, *hop(*RTT_KEYS), *stats('avg'))}, {mean}))", "sent": f"cast({both(SENT_KEYS)} as bigint)", "last_ms": both(LAST_KEYS), "best_ms": both(BEST_KEYS), "worst_ms": both(WORST_KEYS),
        "jitter_ms": pick(f"coalesce(round({_first(_read_number, *stats('jAvg', 'stDev'))}), {_first(_read_lenient, *stats(*STATS_JITTER_KEYS))})", _first(_read_lenient, *hop(*JITTER_KEYS))),
        "packet_loss_percent": pick(_read_lenient(stats("loss")[0]), _first(_read_number, *hop("loss", "packetLoss"))),
    }
    records = (hop, stats, network, system, place)
    rtts = f"filter(transform(try_variant_get(h, '$.timings', 'array<variant>'), x -> {_number(_get('x', 'rtt'))}), x -> x is not null)"
    out = rows.withColumns({r.name: r.object() for r in records} | {"rtts": F.expr(rtts)})
    out = out.withColumns({f"{r.name}_read": r.read() for r in records})
    out = out.select(*keep, "branch", "told", (F.col("i") + 1).alias("hop_seq"), *(F.expr(x).alias(k) for k, x in fields.items()))
    out = out.withColumns({"asn": F.coalesce("asn", inferred_asn(F.col("ip"), F.col("hostname"))), "status": hop_status(F.col("rtt_ms"), F.col("packet_loss_percent"))})
    said = {k: F.when(F.col("branch") < 3, F.col(k)).otherwise(F.col(f"told.{k}")) for k in TOLD}
    return out.withColumns(said).drop("branch", "told")


FAILED = "The measurement provider returned a failed result."
NOTE = "Measured from a nearby network probe. Not a direct trace from your device."


def failure_message(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads with column failure: why a failed measurement failed. A payload's result, if it is an object, stands for it."""
    r = F.expr("coalesce(try_variant_get(v, '$.result', 'map<string, variant>'), try_variant_get(v, '$', 'map<string, variant>'))")
    v = payloads.withColumn("v", F.try_parse_json(column)).withColumn("r", r)
    said = _first(_string, *(f"r['{k}']" for k in ("rawOutput", "error", "message")))
    return v.withColumn("failure", F.expr(f"case when {_string("r['status']")} = 'failed' then coalesce({said}, '{FAILED}') end")).drop("v", "r")


def json_sources(results: DataFrame, column: str = "payload") -> DataFrame:
    """results with struct source: the provider, and what the first result's probe says of itself, by kind, as it stands."""
    p = "try_variant_get(v, '$.probe', 'map<string, variant>')"
    text = lambda k: f"case when schema_of_variant(p['{k}']) = 'STRING' then try_variant_get(p['{k}'], '$', 'string') end"
    fields = [f"'globalping' as provider, {text('id')} as probe_id, {text('city')} as city, {text('country')} as country", f"coalesce({', '.join(map(_plain_asn, ('a0', 'a1', 'a2')))}) as asn"]
    fields += [f"{_number(f"p['{k}']")} as {k}" for k in ("latitude", "longitude")]
    v = results.withColumn("v", F.try_parse_json(column)).withColumn("p", F.expr(p)).withColumn("a0", F.expr("p['asn']"))
    # A network may be an object that says more, two levels deep.
    v = v.withColumn("a1", F.expr(_inner("a0"))).withColumn("a2", F.expr(_inner("a1")))
    return v.withColumn("source", F.expr(f"struct({', '.join(fields)}, '{NOTE}' as note)")).drop("v", "p", "a0", "a1", "a2")


def applied(measurements: DataFrame, results: DataFrame, hops: DataFrame, confidence: DataFrame, key: str = "measurement_id") -> DataFrame:
    """measurements with source, hops and confidence as the provider's result has them; those without a result stay as they are.

    results has (key, payload), hops the decoded hops, confidence (key, confidence) of measurements with hops.
    """
    fields = F.struct(*(c for c in hops.columns if c != key))
    lists = hops.groupBy(key).agg(F.array_sort(F.collect_list(fields), lambda a, b: a["hop_seq"] - b["hop_seq"]).alias("new_hops"))
    new = json_sources(results).select(key, F.col("source").alias("new_source")).join(lists, key, "left").join(confidence.select(key, F.col("confidence").alias("new_confidence")), key, "left")
    out = measurements.join(new, key, "left")
    took = F.col("new_source").isNotNull()
    mine = lambda c: F.col(c) if c in measurements.columns else F.lit(None)
    none = F.expr("slice(new_hops, 1, 0)")
    return out.withColumns({
        "source": F.when(took, F.col("new_source")).otherwise(mine("source")), "hops": F.when(took, F.coalesce("new_hops", none)).otherwise(mine("hops")),
        "confidence": F.when(took, F.coalesce("new_confidence", F.lit("low"))).otherwise(mine("confidence")),
    }).drop("new_source", "new_hops", "new_confidence")
