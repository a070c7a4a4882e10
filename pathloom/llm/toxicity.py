"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else, labelled or not, is unlabelled. Linear classifiers in numpy minimise
    prior * E_P[loss(z, +)] + max(0, E_U[loss(z, -)] - prior * E_P[loss(z, -)])
with the class prior taken from the labels that may be learnt from. Features are the presence of hashed words and word
beginnings. The classifiers are fitted on a bounded sample of rows; every whole text is scored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import checkpointed, fresh, table, text_batches

#: Rows to fit on: about so many confirmed and so many unlabelled ones.
POSITIVES, UNLABELLED = 4_000, 12_000
FEATURES = 3_000
BUCKETS = 1 << 22
THRESHOLD = 0.3
MEMBERS = 3
PIECE = 1 << 20
#: Tokens whose features a task remembers; beyond it forgets them all.
REMEMBER = 60_000


def tokens(text: str | None) -> set[str]:
    """The distinct tokens of a whole text, in lower case, split at white space."""
    text, out, at = text or "", set(), 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        out.update(text[at:end].lower().split())
        at = end
    return out


def features(token: str) -> tuple[int, ...]:
    """Hashed features of a token: the word without marks around it, and its beginnings of 3 to 8 letters."""
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while a < b and not token[b - 1].isalpha():
        b -= 1
    word = token[a:b]
    return tuple({zlib.crc32(f"{n}:{word[:n]}".encode()) % BUCKETS for n in (3, 4, 5, 6, 7, 8, 40) if n == 40 or len(word) > n}) if word else ()


@dataclass
class Model:
    """Sigmoid of the bias and the weights of the features that a text has, averaged over the members."""

    columns: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.full(1, -50.0))

    def score(self, found: list[int]) -> float:
        z = self.bias + self.weights[:, found].sum(axis=1)
        return float(np.mean(1 / (1 + np.exp(-np.clip(z, -50, 50)))))


def risk(z: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """(value, slope by z) of the non-negative risk of outputs z: p and u are the rows' shares of the positive and of the
    unlabelled mean. Where the negative part is below zero the value holds none of it, and the slope is that of making it grow
    again alone: the estimator's own step, without the positive part.
    """
    s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    loss = np.logaddexp(0, z)
    negative, slope = u @ loss - prior * (p @ loss), (u - prior * p) * s
    value = prior * (p @ np.logaddexp(0, -z)) + max(0.0, negative)
    return float(value), prior * p * (s - 1) + slope if negative >= 0 else -slope


def fit(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, prior: float, width: int, steps: int = 400, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias from sparse ones at (rows, cols); positive marks the confirmed rows, the others are unlabelled."""
    rng = np.random.default_rng(seed)
    n, p = len(positive), positive.astype(float)
    # Each member sees its own draw of the unlabelled rows.
    u = (~positive) * (1 + rng.integers(0, 2, n))
    p, u = p / max(p.sum(), 1), u / max(u.sum(), 1)
    w, b = np.zeros(width), math.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        _, g = risk(np.bincount(rows, w[cols], n) + b, p, u, prior)
        grad = np.append(np.bincount(cols, g[rows], width) + 2e-4 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the sample's rows in this task: how many positive and unlabelled ones have each feature."""
    pos, unl, known = {}, {}, {}
    for b in batches:
        for text, y in zip(b["text"], b["positive"]):
            found = set()
            for t in tokens(text):
                if (f := known.get(t)) is None:
                    if len(known) > REMEMBER:
                        known.clear()
                    f = known[t] = features(t)
                found.update(f)
            at = pos if y else unl
            for f in found:
                at[f] = at.get(f, 0) + 1
    keys = list(pos.keys())
    yield pd.DataFrame({"f": keys, "p": [pos[k] for k in keys], "u": [unl.get(k, 0) for k in keys]}).astype("int64")
    keys = [k for k in unl if k not in pos]
    yield pd.DataFrame({"f": keys, "p": [0] * len(keys), "u": [unl[k] for k in keys]}).astype("int64")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Fit on rows of docs and labels, of which the caller has taken away what may not be learnt from.

    With no labels or no toxic ones the model gives 0 throughout. What reaches the driver is the sample's selected features:
    POSITIVES + UNLABELLED rows of at most FEATURES, and as many feature counts.
    """
    text_batches(docs.sparkSession)
    n, y, q = labels.where("toxic is not null").agg(F.count("*"), F.coalesce(F.avg(F.col("toxic").cast("double")), F.lit(0.0)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    total = docs.count()
    if not n or not q or not total:
        return Model()
    prior = min(max(float(y), 0.001), 0.9)
    draw = F.pmod(F.xxhash64(F.lit("draw"), key), F.lit(1 << 30))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), draw.alias("draw"))
    toxic = labels.where((F.col("toxic") == 1) & (draw < int(min(1, POSITIVES / q) * (1 << 30)))).select(F.col(key).alias("key"), draw.alias("turn")).distinct()
    toxic = toxic.orderBy("turn", "key").limit(2 * POSITIVES).select("key")
    positive = rows.join(F.broadcast(toxic), "key").select("text", F.lit(True).alias("positive"))
    sample = rows.where(F.col("draw") < int(min(1, UNLABELLED / total) * (1 << 30))).select("text", F.lit(False).alias("positive"))
    # Read twice: written once.
    sample = checkpointed(positive.union(sample).repartition(8))
    counts = sample.mapInPandas(_counts, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    sizes = sample.groupBy().agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nu")).first()
    least = max(3, math.ceil(0.02 * sizes["np"]))
    ratio = F.log(((F.col("p") + 0.5) / (sizes["np"] + 1)) / ((F.col("u") + 0.5) / (sizes["nu"] + 1)))
    best = counts.where((F.col("p") >= least) & (ratio > 0.6 * math.log(1 / prior))).select("f", (F.col("p") * ratio).alias("gain")).orderBy(F.desc("gain"), "f").limit(FEATURES)
    columns = {r["f"]: i for i, r in enumerate(best.collect())}
    if not columns:
        return Model(bias=np.full(1, math.log(prior / (1 - prior))))

    def found(batches):
        known: dict[str, list[int]] = {}
        for b in batches:
            out = []
            for x in b["text"]:
                got = set()
                for t in tokens(x):
                    if (f := known.get(t)) is None:
                        if len(known) > REMEMBER:
                            known.clear()
                        f = known[t] = [columns[i] for i in features(t) if i in columns]
                    got.update(f)
                out.append(sorted(got))
            yield pd.DataFrame({"positive": b["positive"], "found": out})

    seen = sample.mapInPandas(found, "positive boolean, found array<int>").toPandas()
    # In an order of their own, however they came in, so that a rerun fits the same.
    found_, mark = [list(x) for x in seen["found"]], seen["positive"].tolist()
    seen = seen.iloc[sorted(range(len(seen)), key=lambda i: (mark[i], found_[i]))]
    positive = seen["positive"].to_numpy(bool)
    lengths = seen["found"].map(len).to_numpy()
    cols = np.concatenate([np.asarray(x, np.int64) for x in seen["found"]]) if lengths.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(seen)), lengths)
    fitted = [fit(row, cols, positive, prior, len(columns), seed=s) for s in range(MEMBERS)]
    return Model(columns, np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score column: the likelihood, 0 to 1, that the whole text is toxic.

    Null and empty texts have a score as well, that of a text without features; each row is scored on its text alone, so
    repeated rows agree, and very long texts are read whole. A column of the same name is replaced. An empty table stays empty.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        known: dict[str, tuple[int, ...]] = {}
        columns, none = model.columns, model.score([])
        for b in batches:
            out = []
            for x in b.column(at):
                got: set[int] = set()
                for t in tokens(x.as_py()):
                    f = known.get(t)
                    if f is None:
                        f = tuple(columns[i] for i in features(t) if i in columns)
                        if len(known) > REMEMBER:
                            known.clear()
                        if len(t) <= 40:
                            known[t] = f
                    if f:
                        got.update(f)
                out.append(model.score(sorted(got)) if got else none)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that nothing is learnt from."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def learnt(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    may = ~F.coalesce(held_out(key), F.lit(False))
    return train(docs.where(may), labels.where(may), key=key)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with their own columns; null and empty texts stay."""
    name = fresh(docs, "score")
    return scored(docs, learnt(docs, labels), name=name).where(F.col(name) < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = scored(docs, learnt(docs, labels)).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
