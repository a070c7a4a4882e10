"""Target-distribution importance resampling over hashed features of one and two words.

Two passes in Arrow batches. The first turns each partition into one vector of bucket counts with np.bincount; treeReduce merges
the vectors, so the driver meets a few of them only. The second broadcasts each bucket's gain (BUCKETS numbers) and sums a
document's gains with np.bincount and weights. Scores with seeded Gumbel noise are then ranked: equal rows are folded, a
histogram of the whole-number scores gives the rank at which a score begins, and a window within one score does the rest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import checkpointed, table, text_batches, word_runs

BUCKETS = 10_000
SEED, LEAST_WORDS, PERCENT = 7, 20, 25
#: Bytes of text whose words are in memory at once.
RUN = 2 << 20
#: Words are runs of digits, small letters and bytes beyond ASCII; A-Z counts as small.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))


def _codes(words: list[bytes], numbers: np.ndarray, before: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(document numbers, checksums) of the features that end in these words, and the checksum of the last word and a space.
    before: the document number and that checksum of the word before the first."""
    own = list(map(crc32, words))
    spaced = list(map(crc32, repeat(b" "), own))
    pairs = np.fromiter(map(crc32, words, chain([before[1] if before else 0], spaced)), np.uint32, len(words))
    follows = np.r_[bool(before) and before[0] == numbers[0], numbers[1:] == numbers[:-1]]
    return np.concatenate([numbers, numbers[follows]]), np.concatenate([np.array(own, np.uint32), pairs[follows]]), spaced[-1]


def feature_runs(texts: Iterable[bytes], size: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document numbers, buckets) of all features of texts, for about `size` bytes at a time, however long one text is."""
    words: list[bytes] = []
    owners: list[tuple[int, int]] = []
    held, before = 0, None

    def flush():
        nonlocal held, before
        numbers = np.repeat([i for i, _ in owners], [n for _, n in owners])
        numbers, codes, last = _codes(words, numbers, before)
        before, held = (owners[-1][0], last), 0
        words.clear()
        owners.clear()
        return numbers, (codes % np.uint32(BUCKETS)).astype(np.intp)

    for i, text in enumerate(texts):
        for run in word_runs(text.translate(_BYTES), size):
            if run:
                words += run
                owners.append((i, len(run)))
                held += min(len(text), size)
                if held >= size:
                    yield flush()
    if words:
        yield flush()


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, bucket in feature_runs(x.as_py() for x in b.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    bodies = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))
    vectors = bodies.mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths of a natural logarithm, rounded down, with one added to all counts."""
    all_raw, all_target = int(raw.sum()), int(target.sum())
    ratio = ((t + 1.0) * (all_raw + BUCKETS) / ((s + 1.0) * (all_target + BUCKETS)) for s, t in zip(raw.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(key: int | None, seed: int) -> int:
    """A Gumbel draw for a key, in thousandths, rounded down; null keys draw as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, lot) of every row. weight is the mean gain of its features, rounded down; without
    features it is 0. lot is the partition that the row was read in."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shared.value
        for b in batches:
            n = b.num_rows
            sums, features = np.zeros(n), np.zeros(n, np.int64)
            for numbers, bucket in feature_runs(x.as_py() for x in b.column(1)):
                sums += np.bincount(numbers, weights=gain[bucket], minlength=n)
                features += np.bincount(numbers, minlength=n)
            weight = sums.astype(np.int64) // np.maximum(features, 1)
            score = weight + np.array([noise(k, seed) for k in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(features), pa.array(weight), pa.array(score), b.column(2)], ["key", "n_features", "weight", "score", "lot"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"), F.spark_partition_id().alias("lot"))
    return rows.mapInArrow(run, "key long, n_features long, weight long, score long, lot int")


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_features, weight, score, rank): the highest `percent` of a hundred scores of the rows with `least_words` words have a
    rank from 1 on; ties go to the smaller key, null last. The other rows' rank is null.

    Scores are whole numbers within a range that the gains bound (under 10^5 of them), so their histogram is small whatever the
    rows: one task sums it up. Equal rows of one lot are one row while they are ranked.
    """
    least = 2 * least_words - 1  # features of so many words
    fit = rows.where(F.col("n_features") >= least)
    high = Window.orderBy(F.desc("score"))
    before = high.rowsBetween(Window.unboundedPreceding, -1)
    whole = high.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begins = fit.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    begins = begins.select(F.col("score").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"), F.floor(F.sum("n").over(whole) * percent / 100).alias("most"))
    same = fit.groupBy("score", "key", "n_features", "weight", "lot").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("key"), "n_features", "weight", "lot").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("within", F.coalesce(F.sum("copies").over(order), F.lit(0)))
    # A row for each score, bounded as above.
    same = same.join(F.broadcast(begins), F.col("score") == F.col("at"))
    each = same.select("key", "n_features", "weight", "score", "most", (F.col("above") + F.col("within")).alias("base"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("i"))
    rank = F.col("base") + F.col("i")
    each = each.select("key", "n_features", "weight", "score", F.when(rank <= F.col("most"), rank).alias("rank"))
    rest = rows.where(F.col("n_features") < least).select("key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return each.unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of docs, drawn towards the word distribution of target.

    Both tables have a text column. Null texts have no words. Null keys draw as the empty text and lose ties. Rows that share a
    key get one noise, whether their texts differ or not; rows that repeat get ranks of their own. Very long texts are read in
    runs of words. Empty tables give an empty result, and an empty target the same chance for every bucket. Other columns are ignored, whatever
    their names. Rows are written to the shared folder once they are scored, so that they are scored once.
    """
    text_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    return ranked(checkpointed(scored(docs, gain, text, key, seed)), least_words, percent)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, score and rank towards the texts of the benchmark."""
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("key", "doc_id")


OP12_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), words AS (
  SELECT 'd' AS corpus, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS (
  SELECT corpus, id, f FROM (SELECT corpus, id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words)
), counted AS (
  SELECT corpus, id, f, count(*) AS n FROM features GROUP BY corpus, id, f
), kinds AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), bytes AS (
  SELECT f, list_transform(range(1, length(h), 2), lambda i: CAST(instr('0123456789ABCDEF', substr(h, i, 1)) - 1 AS BIGINT) * 16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1) AS b FROM kinds
), coded AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256))) % 10000 AS bucket FROM bytes, crc_table
), filled AS (
  SELECT bucket, CAST(sum(n) FILTER (WHERE corpus = 'd') AS BIGINT) AS s, CAST(sum(n) FILTER (WHERE corpus = 'b') AS BIGINT) AS t FROM counted JOIN coded USING (f) GROUP BY bucket
), totals AS (SELECT sum(coalesce(s, 0)) AS all_s, sum(coalesce(t, 0)) AS all_t FROM filled
), gained AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_t_s) / ((coalesce(s, 0) + 1.0::DOUBLE) * (all_t_t)))) AS BIGINT) AS gain
  FROM filled, (SELECT CAST(all_s + 10000 AS DOUBLE) AS all_t_s, CAST(all_t + 10000 AS DOUBLE) AS all_t_t FROM totals)
), summed AS (
  SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
  FROM counted JOIN coded USING (f) JOIN gained USING (bucket) WHERE corpus = 'd' GROUP BY id
), weighed AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(floor(total / n_features::DOUBLE), 0) AS BIGINT) AS weight,
         list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', substr(sha256('7:' || d.doc_id), i, 1)) - 1 AS BIGINT))), lambda a, x: a * 16 + x) AS h
  FROM documents d LEFT JOIN summed USING (doc_id)
), noisy AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM noisy WHERE n_features >= 39
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM noisy LEFT JOIN placed USING (doc_id)
"""
