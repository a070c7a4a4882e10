"""Document fingerprints from closed syncmers, matched by position. DataFrame functions only.

Texts are cut into units where their characters say so: a unit ends after 0, 5, the letter o or a character beyond ASCII, and
before white space, so an insertion moves no unit but its own. A k-mer is K units; its inner substrings are windows of S units,
each with a hash. A k-mer is an anchor if the smallest inner hash is that of its first or last window: a choice that looks at
nothing but the k-mer. Each anchor makes a mark of its hash and its distance to the anchor before it, so marks match where anchors
agree and stand alike. The fingerprint is all marks in the order of the text, 8 hex digits each: nothing is left out, and it is
about as long as the text. Likeness is Dice's coefficient over the distinct marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import fresh, parts_for_bytes, table
from pathloom.llm.ranges import range_bounds, range_of

K, S = 5, 2
#: A unit: up to a character that ends it, or up to white space.
UNIT = r"[^\so05\x{80}-\x{10FFFF}]++[^\s]?|[^\s]"


def _anchors(text: str) -> str:
    """SQL: array of (pos, hash) of the anchors, pos counted in units; a text shorter than a k-mer has one for all it has."""
    inner = K - S + 1
    first = " and ".join(f"x <= w[i + {j}]" for j in range(1, inner))
    last = " and ".join(f"w[i + {inner - 1}] <= w[i + {j}]" for j in range(0, inner - 1))
    kmer = ", ".join(f"w[p + {j}]" for j in range(inner))
    units = f"transform(regexp_extract_all({text}, r'{UNIT}', 0), u -> xxhash64(u))"
    # array(...)[0] binds a value to a name, so that it is computed once.
    window = ", ".join(["x", *(f"h[i + {j}]" for j in range(1, S))])
    windows = f"transform(slice(h, 1, size(h) - {S - 1}), (x, i) -> xxhash64({window}))"
    chosen = f"transform(filter(transform(slice(w, 1, size(w) - {inner - 1}), (x, i) -> if(({first}) or ({last}), i, -1)), p -> p >= 0), p -> struct(p as pos, xxhash64({kmer}) as hash))"
    whole = "array(struct(0 as pos, xxhash64(array_join(transform(h, x -> hex(x)), ',')) as hash))"
    return (
        f"transform(array({units}), h -> if(size(h) = 0, cast(array() as array<struct<pos: int, hash: bigint>>),"
        f" if(size(h) < {K}, {whole}, transform(array({windows}), w -> {chosen})[0])))[0]"
    )


def anchors(text: str) -> Column:
    """All anchors of a text column: array of (pos, hash)."""
    return F.expr(_anchors(f"coalesce(cast(`{text}` as string), '')"))


def marks(text: str) -> Column:
    """The marks of a text column, in order: array of int, none negative."""
    own = "if(i = 0, -1, x.pos - a[i - 1].pos)"
    return F.expr(f"transform(array({_anchors(f'`{text}`')}), a -> transform(a, (x, i) -> cast(pmod(xxhash64(x.hash, {own}), 2147483647) as int)))[0]")


def fingerprint(own: str) -> Column:
    """The fingerprint of a column of marks; empty for a text without units."""
    return F.expr(f"array_join(transform({own}, x -> lpad(hex(x), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Likeness of two columns of marks, 0 to 1: twice what both have by what each has. Two without marks are alike, one
    without is like no other."""
    share = f"2D * size(array_intersect({a}, {b})) / (size(array_distinct({a})) + size(array_distinct({b})))"
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1D else {share} end")


def with_next(docs: DataFrame, key: str, columns: list[str], parts: int) -> DataFrame:
    """docs with next_<column> for each of the columns: the value in the next row by key, after the last the first.

    Rows are dealt by ranges of the key, and the first row of each range goes along to the range before it as well, so no
    range needs another. Ties are in the order of the columns' values.
    """
    bounds = range_bounds(docs, key, parts)
    part, guard = fresh(docs, "part"), fresh(docs, "guard")
    rows = docs.withColumn(part, range_of(F.col(key), bounds))
    heads = sorted(rows.groupBy(part).agg(F.min(F.struct(F.col(key).isNotNull(), F.col(key))).alias("least")).collect())
    used = [r[0] for r in heads]
    if not used:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    # The first row of a range is read by the range before; that of the first range by the last.
    least, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for i, r in enumerate(heads):
        least[r[0]], before[r[0]] = r["least"][1], used[i - 1]
    own = lambda xs, kind: F.element_at(F.array(*(F.lit(x).cast(kind) for x in xs)), F.col(part) + 1)
    first = F.when(F.col(key).eqNullSafe(own(least, docs.schema[key].dataType)), own(before, "int"))
    doubled = rows.withColumn(guard, F.explode(F.array_compact(F.array(F.lit(-1), first))))
    doubled = doubled.withColumn(part, F.when(F.col(guard) < 0, F.col(part)).otherwise(F.col(guard))).withColumn(guard, F.col(guard) >= 0)
    order = Window.partitionBy(part).orderBy(guard, F.col(key).asc_nulls_first(), *columns)
    # partitionBy hashes the range's number: as many tasks as ranges at most.
    out = doubled.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return out.where(~F.col(guard)).drop(part, guard)


def compared(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document, the
    first document following the last. Null is the empty text, and very long texts are as any. Rows with the same key, repeated
    rows among them, are in the order of their texts; an empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    parts = parts_for_bytes(rows, "body", 16)
    rows = with_next(rows.withColumn("own", marks("body")), "key", ["body", "own"], parts)
    n = F.char_length("body")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(body, 1, char_length(body) - char_length(body) div 4)"), F.substring(F.col("next_body"), F.lit(1), quarter))
    rows = rows.select("key", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    rows = rows.withColumn("changed", marks("edited")).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    return rows.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, next to those of its edited text and of the next document."""
    return compared(table(spark, sf_dir, "documents"))
