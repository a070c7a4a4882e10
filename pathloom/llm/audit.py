"""Filter interaction audit: what each of five filters removes in every order that they can be applied in.

Words are rows: a text is exploded into its words, which are aggregated by (document, word) and then by document, for totals and
distinct words. The flags that need no words are joined to that, and all documents of a part are reduced to counts of the 32 sets
of filters that a document can fail. Every order's steps follow from those counts alone, without the documents.

Filters: A fewer than LEAST_WORDS words; B fewer than 80 % of the words distinct; C more than 10 % of the characters A to Z;
D one of the characters of MARKS; E the text of a document with a smaller key.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import table

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many characters and then to the end of the word: long texts become several pieces, none of which cuts a word.
PIECE = r"(?s).{1,65536}+[^\x20\x09-\x0D]*+"
SETS = range(1 << len(FILTERS))


def word_counts(rows: DataFrame) -> DataFrame:
    """(key, tag, words, kinds) of rows (key, tag, body): how many words a text has, and how many distinct ones. Texts without
    words have no row.

    Equal rows are folded before they move, and a text moves once: it is then exploded and aggregated where it is.
    """
    texts = rows.groupBy("key", "tag").agg(F.first("body").alias("body"))
    pieces = texts.select("key", "tag", F.explode(F.regexp_extract_all("body", F.lit(PIECE), F.lit(0))).alias("piece"))
    words = pieces.select("key", "tag", F.explode(F.regexp_extract_all("piece", F.lit(WORD), F.lit(0))).alias("word"))
    each = words.groupBy("key", "tag", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("key", "tag").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("kinds"))


def flagged(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """(key, part, n, fails): n documents of one key and part that fail the same filters, a bit each, A the lowest.

    Null texts are empty, and a null part is the empty string. A null key is neither smaller nor larger than another. Rows that
    repeat are documents of their own, none of which has a smaller key. Very long texts are cut into pieces between words. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"),
    ).withColumn("tag", F.xxhash64("body"))
    c = F.regexp_count("body", F.lit("[A-Z]")) * 100 > F.length("body") * CAPITAL_PERCENT
    plain = rows.select("key", "part", "tag", F.unhex(F.sha2("body", 256)).alias("digest"), c.alias("c"), F.col("body").rlike(MARKS).alias("d"))
    plain = plain.groupBy(*plain.columns).agg(F.count(F.lit(1)).alias("n"))
    # The first of equal texts is found by its text and key, so that many copies of one text are many keys of the join.
    first = plain.groupBy(F.col("digest").alias("__digest")).agg(F.min("key").alias("__first"))
    plain = plain.join(first, (F.col("digest") == F.col("__digest")) & (F.col("key") == F.col("__first")), "left")
    plain = plain.withColumn("e", F.col("key").isNotNull() & F.col("__first").isNull())
    counts = word_counts(rows).select(F.col("key").alias("__key"), F.col("tag").alias("__tag"), "words", "kinds")
    both = plain.join(counts, plain["key"].eqNullSafe(counts["__key"]) & (plain["tag"] == counts["__tag"]), "left")
    words, kinds = F.coalesce("words", F.lit(0)), F.coalesce("kinds", F.lit(0))
    bits = (words < LEAST_WORDS, kinds * 100 < words * DISTINCT_PERCENT, F.col("c"), F.col("d"), F.col("e"))
    fails = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return both.select("key", "part", "n", fails.alias("fails"))


def set_counts(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, all_0 …, good_0 …, toxic_0 …): of flagged rows, how many documents fail exactly each set of filters; of them how
    many are labelled of quality 1, and how many toxic. A key that labels has twice counts as labelled if one of its rows is."""
    marks = labels.groupBy(F.col(key).cast("long").alias("__key")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(marks, rows["key"] == marks["__key"], "left")
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    return rows.groupBy("part").agg(*(F.sum(F.when((F.col("fails") == s) & of, F.col("n")).otherwise(0)).alias(f"{name}_{s}") for name, of in kinds.items() for s in SETS))


def steps(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): every step of every
    order, from the counts of sets."""
    orders = F.array(*(F.lit("".join(o)) for o in itertools.permutations(FILTERS)))
    arrays = [F.array(*(F.col(f"{name}_{s}") for s in SETS)).alias(name) for name in ("all", "good", "toxic")]
    rows = counts.select("part", *arrays, F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = F.transform(F.split("filter_order", ""), lambda x: F.pow(F.lit(2), F.ascii(x) - ord(FILTERS[0])).cast("int"))
    rows = rows.withColumn("bits", bits)
    rows = rows.withColumn("own", F.get("bits", F.col("step") - 1)).withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + x))

    def total(of: str, where, times=lambda s: F.lit(1)) -> Column:
        """The sum over the sets s that pass `where`."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(SETS) - 1)), F.lit(0).cast("long"), lambda a, s: a + F.when(where(s), F.get(F.col(of), s) * times(s)).otherwise(F.lit(0).cast("long")))

    own, before = F.col("own"), F.col("before")
    fails, earlier = (lambda s: s.bitwiseAND(own) > 0), (lambda s: s.bitwiseAND(before) > 0)
    here = lambda s: fails(s) & ~earlier(s)
    # A document that fails k filters is removed by each of them in 1 of k orders.
    n_orders = len(list(itertools.permutations(FILTERS)))
    return rows.select(
        "part", "filter_order", "step",
        total("all", lambda s: s.bitwiseAND(own + before) == 0).alias("kept"), total("all", here).alias("removed"), total("all", lambda s: fails(s) & earlier(s)).alias("redundant"),
        total("all", lambda s: s == own).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        total("all", fails, lambda s: (F.lit(n_orders) / F.bit_count(s)).cast("long")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes at every step of all orders, for each language."""
    return steps(set_counts(flagged(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), failing AS (
  SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 10 * length(body) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN min(doc_id) OVER (PARTITION BY body) < doc_id THEN 'E' ELSE '' END AS fails
  FROM texts
), marks AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), places AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
), judged AS (
  SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS hit, len(translate(fails, before, '')) < len(fails) AS gone
  FROM places, counted
), summed AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""
