"""Column functions for addresses and targets."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.text import V4, trimmed
from pathloom.sources import dims


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is bound to a name, so that it is worked out once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def octets(ip: Column) -> Column:
    """Four numbers, or null if the text is anything else."""
    return F.when(ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.transform(F.split(ip, r"\."), lambda x: x.cast("int")))


def is_v4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(V4), F.lit(False))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else. Plain expressions only, which stay within generated code."""
    a, b, c, d = (F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long") for i in (1, 2, 3, 4))
    return F.when(ip.rlike(V4), ((a * 256 + b) * 256 + c) * 256 + d)


def _within(n: Column, ranges: list[str]) -> Column:
    """Whether a number lies in one of the ranges, of which touching ones are one."""
    spans: list[list[int]] = []
    for low, high in sorted(map(dims.v4_range, ranges)):
        if spans and low <= spans[-1][1] + 1:
            spans[-1][1] = max(high, spans[-1][1])
        else:
            spans.append([low, high])
    return functools.reduce(Column.__or__, (n.between(low, high) for low, high in spans))


def is_private(ip: Column) -> Column:
    """Private for network inference: 10/8, 172.16/12, 192.168/16, 100.64/10. Blank octets count as 0."""
    # A blank octet is no number, so the text is looked at only where the cast fails.
    n = F.transform(F.split(ip, r"\.", -1), lambda x: F.coalesce(x.try_cast("int"), F.when(trimmed(x) == "", F.lit(0))))

    def private(n: Column) -> Column:
        a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        hit = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
        return (F.size(n) == 4) & F.forall(n, lambda x: x.isNotNull()) & hit

    # Other texts have not four parts; a failed cast of each would cost more than all else here.
    return F.coalesce(F.when(ip.rlike(r"\A[^.]*(?:\.[^.]*){3}\z"), bound(n, private)), F.lit(False))


# Ranges that are never looked up.
NOT_LOOKED_UP = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/16", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3"]


def is_public(ip: Column) -> Column:
    """Whether an address may be looked up; IPv6 may not."""
    return F.coalesce(bound(ip_number(ip), lambda n: ~_within(n, NOT_LOOKED_UP)), F.lit(False))


def is_blocked(ip: Column) -> Column:
    """Whether a target address is blocked; what isn't an IPv4 address is."""
    return F.coalesce(bound(ip_number(ip), lambda n: _within(n, dims.BLOCKED_V4)), F.lit(True))


def v6_groups(ip: Column) -> Column:
    """The eight numbers of an IPv6 address, which may end in an IPv4 address or a zone; null for anything else."""
    none = F.expr("cast(array() as array<string>)")
    parts = lambda h: F.when(h == "", none).otherwise(F.split(h, ":", -1))

    def plain(own: Column) -> Column:
        """own with an IPv4 address at its end as two groups."""
        tail = F.regexp_extract(own, r":((?:[0-9]{1,3}\.){3}[0-9]{1,3})$", 1)
        two = lambda n: F.concat(F.regexp_replace(own, r"[0-9.]+$", ""), F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(n % 65536)))
        return F.when(F.contains(own, F.lit(".")), bound(ip_number(tail), lambda n: F.when(n.isNotNull(), two(n)))).otherwise(own)

    def groups(halves: Column) -> Column:
        sides = F.struct(F.size(halves).alias("n"), parts(F.get(halves, F.lit(0))).alias("left"), parts(F.get(halves, F.lit(1))).alias("right"))
        short = lambda s: 8 - F.size(s["left"]) - F.size(s["right"])
        return bound(sides, lambda s: F.when(s["n"] == 1, s["left"]).when((s["n"] == 2) & (short(s) > 0), F.concat(s["left"], F.array_repeat(F.lit("0"), short(s)), s["right"])))

    def numbers(g: Column) -> Column:
        return F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.transform(g, lambda x: F.conv(x, 16, 10).cast("int")))

    own = F.regexp_replace(F.lower(ip), "%[^%/]+$", "")
    return bound(bound(F.split(bound(own, plain), "::", -1), groups), numbers)


def is_blocked_v6(ip: Column) -> Column:
    """Whether an IPv6 address is blocked; null if the text isn't one."""

    def within(g: Column) -> Column:
        hit = F.lit(False)
        for low, bits in map(dims.v6_range, dims.BLOCKED_V6):
            inside = F.lit(True)
            for i in range(-(-bits // 16)):
                mask = 0xFFFF ^ ((1 << max(0, 16 * (i + 1) - bits)) - 1)
                inside = inside & (g[i].bitwiseAND(F.lit(mask)) == low[i])
            hit = hit | inside
        return F.when(g.isNotNull(), hit)

    return bound(v6_groups(ip), within)


# Networks by parts of the host name and beginnings of the address, first match wins.
ASN_RULES = [
    ("AS15169", ["google", "1e100.net"], ["142.250.", "142.251.", "108.170.", "72.14.", "192.178."], None),
    ("AS13335", ["cloudflare"], ["172.64."], "1.1.1.1"),
    ("AS8560", ["ionos", "1and1", "oneandone"], ["212.227.", "82.165."], None),
    ("AS4637", ["telstraglobal.net"], ["202.84."], None),
]


def inferred_asn(ip: Column, host: Column) -> Column:
    """The network that an address or a host name speaks for; AS??? for private addresses; null if none."""
    ip, host = F.coalesce(ip, F.lit("")), F.lower(F.coalesce(host, F.lit("")))
    out = F.when(is_private(ip), F.lit("AS???"))
    for asn, names, starts, exact in ASN_RULES:
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(host, F.lit(n))
        for s in starts:
            hit = hit | F.startswith(ip, F.lit(s))
        out = out.when(hit | (ip == exact) if exact else hit, F.lit(asn))
    return out


LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
UNSAFE = r"[;&|<>`$\\'\"()\[\]{}\x00-\x20\x7f]"
# What a refused target is told.
ERRORS = {
    "length": "Target must be between 1 and 253 characters.",
    "url": "Enter only a domain or IP address, not a URL or command.",
    "public_ip": "Enter a public domain or public IP address.",
    "public": "Enter a public domain or public IP address.",
    "invalid": "Enter a valid domain or IP address.",
}


def is_domain(s: Column) -> Column:
    return s.rlike(rf"^(?:{LABEL}\.)+[a-z]{{2,63}}$")


def is_reserved(s: Column) -> Column:
    hit = s.isin("localhost", "localdomain")
    for suffix in dims.RESERVED_SUFFIXES:
        hit = hit | F.endswith(s, F.lit(suffix))
    return hit


def normal_target(s: Column) -> tuple[Column, Column]:
    """(target, error): the lower-case target, or why it is refused."""
    t = F.lower(trimmed(s))
    v4, v6 = is_v4(t) & t.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$"), F.contains(t, F.lit(":"))
    error = (
        F.when((F.length(t) == 0) | (F.length(t) > 253), ERRORS["length"])
        .when(F.contains(t, F.lit("/")) | t.rlike(UNSAFE), ERRORS["url"])
        .when(v4, F.when(is_blocked(t), ERRORS["public_ip"]))
        .when(v6, F.when(is_blocked_v6(t).isNull(), ERRORS["invalid"]).when(is_blocked_v6(t), ERRORS["public_ip"]))
        .when(is_domain(t), F.when(is_reserved(t), ERRORS["public"]))
        .otherwise(ERRORS["invalid"])
    )
    return F.when(error.isNull(), t), error


MODE_ERROR = "Mode must be traceout or mtr."


def normal_mode(s: Column) -> Column:
    return F.when(s.isin("traceout", "mtr"), s)


def mode_error(s: Column) -> Column:
    """Why a mode is refused; null if it isn't."""
    return F.when(~F.coalesce(s.isin("traceout", "mtr"), F.lit(False)), MODE_ERROR)
