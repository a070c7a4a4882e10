"""Small shared helpers of the corpus operators."""

from __future__ import annotations

import itertools
import re
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_names = itertools.count()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session within one process may go without: it gets one of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathloom-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand texts to Python in batches of `rows` rows, unless the session has its own setting.

    The default, 10,000 rows, is meant for narrow rows: of texts, several such batches at once are most of an executor's
    memory outside the heap. The setting holds for the session, as it is read when a job starts.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    return next(x for x in (f"__{stem}_{next(_names)}" for _ in itertools.count()) if x not in df.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for_bytes(df: DataFrame, col: str, mb: int) -> int:
    """Partitions of about mb megabytes for what the text column holds in all, at least the session's shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(col))).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), -(-int(total) // (mb << 20)), 1)


def word_runs(data: bytes, size: int):
    """The words of data in runs of about `size` bytes, so a huge text never becomes one list of words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end = min([x for x in (data.find(c, end) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")) if x >= 0], default=len(data))
        yield data[at:end].split()
        at = end


class LocalSets:
    """Disjoint sets over 0..n-1 fed with arrays of pairs; the label of a set is its smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        lab = self.label
        while True:
            a, b = lab[i], lab[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = lab[lab]
                if np.array_equal(up, lab):
                    break
                lab[:] = up


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (u, v) long pairs as rows (node, root), root the smallest node; nodes without edges don't appear.

    Large-star then small-star steps over the edge table until each component is one star, that is, until no node with a smaller
    neighbour has another one. Minima are pre-aggregated and joined back, so a node with very many edges is a skewed join, never
    one task's group.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    for _ in range(rounds):
        ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("lower")), F.struct(F.col("v").alias("node"), F.lit(0).alias("lower")))))
        if ends.groupBy("node").agg(F.count("*").alias("n"), F.max("lower").alias("lower")).where("n > 1 AND lower = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        low = edges.select(F.inline(F.array(pair("u", "v"), pair("v", "u")))).groupBy("u").agg(F.min("v").alias("m"))
        large = edges.join(low.select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "v").select("u", F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.inline(F.array(pair("v", "m"), pair("u", "m"))))
        edges = checkpointed(small.where("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
