"""Column functions for text: numbers, network numbers, host names and measurements in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column
#: An IPv4 address; leading zeros may be there, as in other octets of up to three digits.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def trimmed(s: C) -> C:
    """Without white space at either end; the built-in trim takes spaces only."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def or_null(s: C) -> C:
    return F.nullif(s, F.lit(""))


def split_on(s: C, rx: str) -> C:
    """Parts between matches of rx, none of them empty."""
    return F.filter(F.split(s, rx, -1), lambda x: x != "")


def words(s: C) -> C:
    """Split at one character that isn't a pattern, which Spark doesn't compile anew for each row."""
    return split_on(F.translate(s, "\t\n\x0b\f\r", "     "), " ")


def is_digits(s: C, most: int) -> C:
    return F.coalesce(s.rlike(f"^[0-9]{{1,{most}}}$"), F.lit(False))


def is_decimal(s: C) -> C:
    """Digits with one dot at most and a digit at least."""
    return F.coalesce(s.rlike(r"^(?=.*[0-9])[0-9]*\.?[0-9]*$"), F.lit(False))


def number(s: C) -> C:
    """A lenient number: a trailing per cent sign is dropped, blank text is 0, what isn't a number is null."""
    t = trimmed(F.regexp_replace(trimmed(s), r"%$", ""))
    return F.when(t == "", F.lit(0.0)).when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def number_of_word(s: C) -> C:
    """The same of a text without white space, as one of words() is."""
    bare = F.when(F.endswith(s, F.lit("%")), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    read = lambda x: F.when(x == "", F.lit(0.0)).when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double"))
    return F.get(F.transform(F.array(bare), read), F.lit(0))


def asn_digits(s: C) -> C:
    """The digits of the first "AS" that nothing alphanumeric precedes."""
    return or_null(F.regexp_extract(s, r"(?<![A-Za-z0-9])[Aa][Ss]\s*([0-9]+)", 1))


def asn_of(s: C) -> C:
    """AS and number from a text."""
    d = asn_digits(s)
    return F.when(d.isNotNull(), F.concat(F.lit("AS"), d))


def normal_asn(s: C) -> C:
    """AS and number from a number, a text with "AS", or the mark of an unknown network."""
    t = trimmed(s)
    return F.when(t == "AS???", t).when(is_digits(t, 10), F.concat(F.lit("AS"), t)).otherwise(asn_of(t))


def stated_asn(s: C) -> C:
    """The same of a measurement's own text, which may write the mark of an unknown network in any case."""
    return F.when(F.upper(trimmed(s)) == "AS???", F.lit("AS???")).otherwise(normal_asn(s))


def without_trailing_slashes(s: C) -> C:
    return F.regexp_replace(s, r"/+\z", "")


def without_asn_prefix(s: C) -> C:
    return or_null(trimmed(F.regexp_replace(s, r"^\s*[Aa][Ss][0-9]+ \s*", "")))


def compact(s: C) -> C:
    return F.regexp_replace(s, r"\s", "")


def host_tokens(host: C) -> C:
    """Lower-case parts of a host name without digits at their edges."""
    parts = F.split(F.lower(host), r"[._()\s-]", -1)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[0-9]+|[0-9]+$", "")), lambda x: x != "")


def rtt_values(s: C) -> C:
    """All numbers that are followed by "ms". Each number is taken once, so a later part of it can't match alone."""
    found = F.regexp_extract_all(s, F.lit(r"[0-9]++(?:\.[0-9]*+)?+(?:\s*[mM][sS])?"), F.lit(0))
    return F.transform(F.filter(found, lambda x: x.rlike("[mM][sS]$")), lambda x: F.regexp_extract(x, r"^[0-9]+(\.[0-9]+)?", 0).cast("double"))


def ipv4_in(s: C) -> C:
    """The first maximal run of digits and dots that is an IPv4 address."""
    return F.get(F.filter(F.regexp_extract_all(s, F.lit("([0-9][0-9.]*)"), F.lit(1)), lambda x: x.rlike(V4)), F.lit(0))


def html_escaped(s: C) -> C:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def padded_left(s: C, n: int) -> C:
    """Padded to n characters; longer texts stay whole."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, " "))


def padded_right(s: C, n: int) -> C:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, " "))


def joined(sep: str, *parts: C) -> C:
    """The parts that are neither null nor empty."""
    return F.concat_ws(sep, *(or_null(p) for p in parts))
