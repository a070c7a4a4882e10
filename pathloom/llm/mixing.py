"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / size copies, so the prefix sum of expected copies is the document's rank times
that rate. With one random offset for each source, a document is taken once for each integer that its step crosses. Ranks
follow size classes, so each size class is taken in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import checkpointed, fresh, table

WORD = r"[^\x20\x09-\x0D]+"
#: No source is taken more than this many times its size.
MOST = 3.0
#: Lots into which documents of one source and size class are dealt, so that no source is ranked in one task.
LOTS = 256


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): weights 1, 2, 3 by order of the source, null last.

    Each source gets the whole's words in proportion to its weight, or MOST times its size where that is less; what is
    over goes to the others by weight. Sources sorted by size over weight are full up to a point. What is left for a unit of
    weight, source by source in that order, rises as long as sources are full and falls after, so its maximum is the level.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    order = [(F.lit(MOST) * F.col("source_size")) / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"),
        F.sum("weight").over(after).alias("sharing"),
    )
    level = (F.col("total") - F.lit(MOST) * F.col("full")) / F.col("sharing")
    by = by.withColumn("level", F.max(level).over(everything))
    target = F.least(F.col("level") * F.col("weight"), F.lit(MOST) * F.col("source_size"))
    return by.select("source", "source_size", target.alias("target"))


def _fraction(text):
    """A number in [0, 1) that depends on the text alone."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "") -> DataFrame:
    """(key, size, source, source_size, target, copies) for each row of docs.

    Null and empty texts have size 0 and may be taken; a source of only such texts has target 0 and none is taken. A null
    source is a source of its own. Ties and repeated rows are told apart by rank alone, so reruns agree on each distinct row.
    Very long texts count as any. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = checkpointed(docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
    ))
    # Size classes: the bit length of the size and its next three bits.
    bits = F.length(F.bin("size"))
    rows = rows.withColumn("class", bits * 8 + F.expr("pmod(shiftright(size * 8, length(bin(size)) - 1), 8)").cast("int"))
    rows = rows.withColumn("lot", F.conv(F.substring(F.md5(F.coalesce(F.col("key").cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int"))
    lots = rows.groupBy("source", "class", "lot").agg(F.count("*").alias("n"))
    # A source has some hundred size classes at most, times LOTS.
    lots = lots.select("source", "class", "lot", (F.sum("n").over(Window.partitionBy("source").orderBy("class", "lot")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "class", "lot").orderBy("size", "key"))
    ranked = rows.withColumn("rank", rank)
    targets = source_targets(rows).withColumnRenamed("source", "of")
    about = lots.join(targets, lots["source"].eqNullSafe(targets["of"])).drop("of")
    about = about.select(F.col("source").alias("of"), F.col("class").alias("of_class"), F.col("lot").alias("of_lot"), "before", "source_size", "target")
    ranked = ranked.join(about, ranked["source"].eqNullSafe(about["of"]) & (F.col("class") == F.col("of_class")) & (F.col("lot") == F.col("of_lot")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _fraction(F.concat(F.lit(seed), F.lit("/"), F.coalesce("source", F.lit(""))))
    at = F.col("before") + F.col("rank")
    copies = F.least(F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset), F.lit(int(MOST)).cast("long"))
    return ranked.select(F.col("key").alias(key), "size", F.col("source").alias(source), "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "") -> DataFrame:
    """The rows of docs, each as often as it is taken; columns stay as they are.

    Copies are dealt to the rows of a key in turn where keys repeat, in the order of their sizes and texts, so repeated rows are
    neither lost nor doubled and reruns agree. Null and empty texts may be taken, very long ones count as any; an empty table
    gives an empty result; other columns may have any names.
    """
    k, n, c = (fresh(docs, x) for x in ("key", "turn", "copies"))
    same = Window.partitionBy("key").orderBy("size", "copies")
    taken = mixed(docs, text, key, source, seed).select(F.col(key).alias("key"), "size", "copies").withColumn("turn", F.row_number().over(same))
    taken = taken.select(F.col("key").alias(k), F.col("turn").alias(n), F.col("copies").alias(c))
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = docs.withColumn(n + "_", F.row_number().over(Window.partitionBy(key).orderBy(size, F.xxhash64(F.col(source).cast("string"), F.col(text).cast("string")))))
    out = rows.join(taken, rows[key].eqNullSafe(taken[k]) & (rows[n + "_"] == taken[n]))
    out = out.where(F.col(c) > 0).withColumn(c, F.explode(F.array_repeat(F.lit(1), F.col(c).cast("int"))))
    return out.select(*(F.col(f"`{x}`") for x in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, next to its source's size and target."""
    m = mixed(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), classed AS (
  SELECT *, len(bin(size)) * 8 + CAST(((size * 8) >> (len(bin(size)) - 1)) % 8 AS INT) AS class,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS INT) AS lot
  FROM sized
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, lot, size, doc_id) AS place FROM classed
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         CAST(coalesce(sum(source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS full_,
         CAST(sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS sharing
  FROM totals
), leveled AS (
  SELECT *, max((total - 3.0::DOUBLE * full_) / sharing) OVER () AS level FROM ordered
), targets AS (
  SELECT source, source_size, least(level * weight, 3.0::DOUBLE * source_size) AS target FROM leveled
), rated AS (
  SELECT doc_id, size, source_size, target, place, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         CAST('0x' || substr(md5('/' || coalesce(r.source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start_
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(place * rate + start_) - floor((place - 1) * rate + start_), 3) AS BIGINT) * size AS taken
FROM rated
"""
