"""Addresses against tables of ranges: a prefix join, for IPv4 and IPv6 alike.

An address is a key of 128 bits in two longs, IPv4 in the upper half of the first. A range is a prefix, or is broken into the few
prefixes that make it up. For each prefix length that the table has, an address is cut to that length, and what is left is looked
up by equality. That is a hash join with a row for each address and length (162 lengths at most), whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.frames import worked_out
from pathloom.functions.net import bound, ip_number, is_v4, v6_groups

PREFIX = ["family", "bits", "hi", "lo"]


def _half(groups: Column, first: int) -> Column:
    """Four of an address's eight groups as a long."""
    part = [groups[first + i].cast("long") for i in range(4)]
    return F.shiftleft(part[0], 48).bitwiseOR(F.shiftleft(part[1], 32)).bitwiseOR(F.shiftleft(part[2], 16)).bitwiseOR(part[3])


def address_key(ip: Column) -> Column:
    """(family, hi, lo) of an address as text, family 4 or 6; null for what isn't one."""
    v4 = F.struct(F.lit(4).alias("family"), F.shiftleft(ip_number(ip), 32).alias("hi"), F.lit(0).cast("long").alias("lo"))
    v6 = bound(v6_groups(ip), lambda g: F.when(g.isNotNull(), F.struct(F.lit(6).alias("family"), _half(g, 0).alias("hi"), _half(g, 4).alias("lo"))))
    return F.when(F.contains(ip, F.lit(":")), v6).when(is_v4(ip), v4)


def _mask(bits: Column, before: int) -> Column:
    """The mask of a long that `before` bits precede: its leading ones as far as the prefix goes."""
    own = F.greatest(F.lit(0), F.least(F.lit(64), bits - before))
    return F.when(own == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), 64 - own))


def cidr_prefixes(ranges: DataFrame, column: str = "cidr") -> DataFrame:
    """ranges with columns PREFIX of a range as text, address and length; an address alone is a whole prefix. Rows whose text is
    no range go. Bits beyond the length count as zero."""
    length = F.split_part(F.col(column), F.lit("/"), F.lit(2))
    rows = worked_out(ranges, {"__address": F.split_part(F.col(column), F.lit("/"), F.lit(1))})
    rows = worked_out(rows, {"__key": address_key(F.col("__address"))}).drop("__address")
    most = F.when(F.col("__key.family") == 4, 32).otherwise(128)
    rows = rows.withColumn("bits", F.when(F.contains(column, F.lit("/")), length.try_cast("int")).otherwise(most)).where(F.col("__key").isNotNull() & F.col("bits").between(0, most))
    cut = {"hi": F.col("__key.hi").bitwiseAND(_mask(F.col("bits"), 0)), "lo": F.col("__key.lo").bitwiseAND(_mask(F.col("bits"), 64)), "family": F.col("__key.family")}
    return rows.withColumns(cut).drop("__key")


def span_prefixes(spans: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """spans with columns PREFIX of IPv4 numbers low to high, a row for each of the least number of prefixes that make a span up.

    For each size of block, the numbers from which whole blocks begin and at which they end; an odd one at either end is a block
    that no larger one holds.
    """
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__k"))
    rows = spans.where(F.col(low).between(0, F.col(high)) & (F.col(high) < 1 << 32)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(32))))
    rows = rows.withColumn("__a", F.floor((F.col(low) + size - 1) / size)).withColumn("__b", F.floor((F.col(high) + 1) / size)).where("__a < __b")
    ends = F.array_compact(F.array(F.when(F.col("__a") % 2 == 1, F.col("__a")), F.when(F.col("__b") % 2 == 1, F.col("__b") - 1)))
    rows = rows.withColumn("__at", F.explode(F.array_distinct(ends)))
    new = {"family": F.lit(4), "bits": 32 - F.col("__k"), "hi": F.shiftleft(F.col("__at") * size, 32), "lo": F.lit(0).cast("long")}
    return rows.withColumns(new).drop("__k", "__a", "__b", "__at")


def prefix_matches(addresses: DataFrame, ip: str, prefixes: DataFrame) -> DataFrame:
    """(ip, bits, the other columns of prefixes): every distinct address with every prefix that holds it. Texts that are no address
    match nothing."""
    lengths = sorted(tuple(r) for r in prefixes.select("family", "bits").distinct().collect())  # 33 and 129 of them at most
    kind = "struct<family: int, bits: int, hi: long, lo: long>"

    def cut(family: int) -> Column:
        k, out = F.col("__key"), []
        for bits in (b for f, b in lengths if f == family):
            mask = (1 << 128) - (1 << (128 - bits))
            high, low = ((m ^ (1 << 63)) - (1 << 63) for m in (mask >> 64, mask & ((1 << 64) - 1)))
            out.append(F.struct(F.lit(family).alias("family"), F.lit(bits).alias("bits"), k["hi"].bitwiseAND(F.lit(high)).alias("hi"), k["lo"].bitwiseAND(F.lit(low)).alias("lo")).cast(kind))
        return F.array(*out).cast(f"array<{kind}>")

    rows = worked_out(addresses.select(ip).distinct(), {"__key": address_key(F.col(ip))})
    rows = rows.select(ip, F.inline(F.when(F.col("__key.family") == 4, cut(4)).when(F.col("__key.family") == 6, cut(6))))
    return rows.join(prefixes, PREFIX).select(ip, "bits", *(c for c in prefixes.columns if c not in PREFIX))


def longest_prefix(addresses: DataFrame, ip: str, prefixes: DataFrame) -> DataFrame:
    """addresses with the other columns of prefixes, from the longest prefix that holds the address, of equal ones the least row;
    null where none does."""
    own = [c for c in prefixes.columns if c not in PREFIX]
    each = prefixes.groupBy(*PREFIX).agg(F.min(F.struct(*own)).alias("__row"))
    best = prefix_matches(addresses, ip, each).groupBy(F.col(ip).alias("__ip")).agg(F.max_by("__row", "bits").alias("__row"))
    out = addresses.join(best, F.col(ip) == F.col("__ip"), "left")
    return out.select(*addresses.columns, *(F.col("__row")[c].alias(c) for c in own))


def outside(addresses: DataFrame, ip: str, prefixes: DataFrame) -> DataFrame:
    """The distinct IPv4 addresses, and texts with a colon, that no prefix holds."""
    rows = worked_out(addresses.select(ip).distinct(), {"__is": is_v4(F.col(ip)) | F.contains(ip, F.lit(":"))}).where("__is").drop("__is")
    held = prefix_matches(addresses, ip, prefixes).select(F.col(ip).alias("__ip")).distinct()
    return rows.join(held, rows[ip] == F.col("__ip"), "left_anti")
