"""Host names against place aliases by an inverted index.

An alias of four letters and more counts at the end of a token of the name, one of five and more anywhere in it, and a shorter
one only as a whole token; a hyphen in an alias may be left out. Names are broken into keys: their tokens, and the grams of
their tokens and of the whole name with the rest that follows. Keys meet aliases by equality; what follows is compared after the
join. The least match by place and alias wins. Work grows with the names and the matches, not with names times aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import text as t
from pathloom.functions.frames import worked_out

TOKEN, ENDING, ANYWHERE = 0, 1, 2


def alias_index(aliases: DataFrame) -> tuple[DataFrame, int]:
    """(kind, key, form, city_ord, alias_ord, alias) of (city_ord, alias_ord, alias), and the length of a gram, which is that of the
    shortest form of an alias of four letters and more."""
    forms = F.array_distinct(F.array(F.col("alias"), F.replace(F.col("alias"), F.lit("-"), F.lit(""))))
    rows = aliases.where("alias <> ''").select("*", F.explode(forms).alias("form")).where("form <> ''")
    n = F.length("alias")
    gram = rows.where(n >= 4).agg(F.min(F.length("form"))).first()[0] or 1
    kind = F.when(n < 4, TOKEN).when(n == 4, ENDING).otherwise(ANYWHERE)
    key = F.when(n < 4, F.col("form")).otherwise(F.substring("form", 1, gram))
    return rows.select(kind.alias("kind"), key.alias("key"), "form", "city_ord", "alias_ord", "alias"), gram


def host_keys(host: Column, gram: int) -> Column:
    """Array of (kind, key, rest) of a name, rest being what begins with the key."""
    entry = lambda kind, key, rest: F.struct(F.lit(kind).alias("kind"), key.alias("key"), rest.alias("rest"))
    none = F.expr("cast(array() as array<struct<kind: int, key: string, rest: string>>)")

    def grams(s: Column, kind: int) -> Column:
        at = F.sequence(F.lit(1), F.length(s) - gram + 1)
        return F.when(F.length(s) >= gram, F.transform(at, lambda i: entry(kind, F.substring(s, i, F.lit(gram)), F.substring(s, i, F.length(s))))).otherwise(none)

    tokens, flat = t.host_tokens(host), t.compact(F.lower(host))
    whole = F.transform(tokens, lambda x: entry(TOKEN, x, x))
    return F.concat(whole, F.flatten(F.transform(tokens, lambda x: grams(x, ENDING))), grams(flat, ANYWHERE))


def host_matches(names: DataFrame, host: str, aliases: DataFrame) -> DataFrame:
    """(host, match) of the distinct names that an alias matches; match is the first (city_ord, alias_ord, alias)."""
    index, gram = alias_index(aliases)
    keys = names.select(host).where(F.col(host).isNotNull()).distinct()
    keys = worked_out(keys, {"__keys": host_keys(F.col(host), gram)}).select(host, F.inline("__keys"))
    met = keys.join(index, ["kind", "key"]).where(
        F.when(F.col("kind") == TOKEN, True).when(F.col("kind") == ENDING, F.col("rest") == F.col("form")).otherwise(F.startswith("rest", "form"))
    )
    return met.groupBy(host).agg(F.min(F.struct("city_ord", "alias_ord", "alias")).alias("match"))
