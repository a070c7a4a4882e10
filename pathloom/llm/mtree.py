"""Exact top-k by inner product: an M-tree over all vectors, searched best first in bulk.

A vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest length, and a query q gets 0 there. Then
d(q, x)^2 = |q|^2 + M^2 - 2 <q, x>, so the nearest are those with the highest inner products, in a metric.

The root page has at most PIVOTS pivots, drawn from the vectors; each vector belongs to its nearest pivot and keeps its
distance to it, the parent distance. A pivot's vectors are cut into rings by parent distance, at most RINGS of them, and a ring
into leaf pages of about PAGE vectors. A ring's node has its least and greatest parent distance, so the root and its nodes are
bounded tables whatever the number of vectors, and only they are sent to the tasks.

A search goes in two rounds. The first reads each query's nearest nodes, as many as hold enough vectors; the k-th best score
found bounds the distance. The second reads the nodes that the triangle inequality can't rule out against that bound. In a page
the stored parent distances rule out entries before any product is computed. Queries travel to pages; a page that many queries
ask for is copied once for every BLOCK of them. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import checkpointed, table

PIVOTS, RINGS, PAGE, BLOCK = 4_096, 8, 1_024, 4_096
#: Queries of a page that are compared together, neighbours by their distance to the page's pivot.
CHUNK = 128
PAGE_KEY = ["dim", "cell", "ring", "salt"]
ROUTED = "id long, dim int, cell int, near double, v binary"
ASKED = "id long, dim int, cell int, ring int, salt int, here double, reach double, v binary"


def prepared(vectors: DataFrame, vector: str, key: str, scale: int) -> DataFrame:
    """(id, dim, v): rows whose components are all finite, each component floor(scale * x) as a long. Equal rows count once."""
    whole = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(whole).select(
        F.col(key).cast("long").alias("id"), F.size(vector).alias("dim"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    ).distinct()


@dataclass
class Tree:
    """The root page: per length of vector its pivots, and the nodes (cell, ring, least, greatest parent distance, vectors)."""

    lift: float
    pivots: dict[int, np.ndarray]
    page: int = PAGE
    nodes: dict[int, np.ndarray] = field(default_factory=dict)

    def to_pivots(self, dim: int, points: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances of integer rows to the pivots of their length, the origin's last; vectors are lifted, queries are not."""
        points, pivots = points.astype(float), self.pivots.get(dim, np.zeros((0, dim))).astype(float)
        pivots = np.vstack([pivots, np.zeros((1, dim))])
        own, other = (points**2).sum(axis=1), (pivots**2).sum(axis=1)
        height = np.sqrt(np.maximum(self.lift - other, 0))
        height[-1] = 0.0  # the origin isn't lifted
        dot = points @ pivots.T
        square = own[:, None] + other + height**2 - 2 * dot
        if lifted:
            up = np.sqrt(np.maximum(self.lift - own, 0))
            square += (up**2)[:, None] - 2 * up[:, None] * height
        return np.sqrt(np.maximum(square, 0))

    def slack(self, q: np.ndarray) -> np.ndarray:
        return 1e-6 * (1 + np.sqrt(self.lift) + np.sqrt((q.astype(float) ** 2).sum(axis=1)))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far off a vector of at least this score may be, with room for rounding; -inf as score gives all."""
        return np.sqrt(np.maximum((q.astype(float) ** 2).sum(axis=1) + self.lift - 2 * score, 0)) + self.slack(q)

    def salts(self, count: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-count // self.page)).astype(int)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    raw = column.to_pylist() if isinstance(column, pa.Array | pa.ChunkedArray) else list(column)
    return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), dim)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows of the batch, their integer points) for each length of vector in a batch of (id, dim, v, …)."""
    dims, v = b.column("dim").to_numpy(), b.column("v")
    bounds, flat = v.offsets.to_numpy(), v.values.to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, flat[(bounds[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim) if dim else np.zeros((len(at), 0), np.int64)


def _raw_rows(points: np.ndarray) -> pa.Array:
    return pa.array([p.tobytes() for p in points.astype("<i8")], pa.binary())


def routed(rows: DataFrame, tree: Tree) -> DataFrame:
    """(id, dim, cell, near, v): each vector's nearest pivot and parent distance."""

    def run(batches):
        for b in batches:
            for dim, at, points in _by_dim(b):
                d = tree.to_pivots(dim, points, True)
                cell = d.argmin(axis=1)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at)), pa.array(np.full(n, dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(n), cell]), _raw_rows(points)],
                    ["id", "dim", "cell", "near", "v"],
                )

    return rows.mapInArrow(run, ROUTED)


def paged(vectors: DataFrame, tree: Tree) -> DataFrame:
    """routed vectors with ring and salt, which name their page; the tree gets its nodes."""
    spark = vectors.sparkSession
    cut = F.percentile_approx("near", [i / RINGS for i in range(1, RINGS)], 1_000)
    cells = vectors.groupBy("dim", "cell").agg(F.count("*").alias("n"), cut.alias("edges")).where(F.col("n") > tree.page)
    # At most a row for each pivot.
    cells = [(r["dim"], r["cell"], r["edges"]) for r in cells.collect()]
    cells = F.broadcast(spark.createDataFrame(cells, "dim int, cell int, edges array<double>"))
    rows = vectors.join(cells, ["dim", "cell"], "left").withColumn("ring", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("near"))), F.lit(0)).cast("int"))
    rows = rows.withColumn("ring", F.when(F.col("edges").isNull(), 0).otherwise(F.col("ring"))).drop("edges")
    # At most RINGS rows for each pivot.
    nodes = rows.groupBy("dim", "cell", "ring").agg(F.min("near"), F.max("near"), F.count("*")).collect()
    by: dict[int, list] = {}
    for dim, *node in sorted(tuple(r) for r in nodes):
        by.setdefault(dim, []).append(node)
    tree.nodes = {dim: np.array(x, float) for dim, x in by.items()}
    salts = [(dim, int(c), int(r), int(s)) for dim, x in tree.nodes.items() for c, r, s in zip(x[:, 0], x[:, 1], tree.salts(x[:, 4]))]
    salts = F.broadcast(spark.createDataFrame(salts, "dim int, cell int, ring int, salts int"))
    return rows.join(salts, ["dim", "cell", "ring"]).withColumn("salt", F.pmod(F.xxhash64("id", "v"), F.col("salts")).cast("int")).drop("salts")


def _nodes_asked(tree: Tree, dim: int, q: np.ndarray, k: int, score: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, nodes, distances to the nodes' pivots, reach): the first round's pairs without scores, else the second's."""
    nodes = tree.nodes.get(dim)
    if nodes is None:
        return
    d = tree.to_pivots(dim, q, False)[:, nodes[:, 0].astype(int)]
    low = np.maximum(np.maximum(d - nodes[:, 3], nodes[:, 2] - d), 0)
    order = np.lexsort((d, low), axis=1) if len(nodes) > 1 else np.zeros((len(q), 1), int)
    before = np.cumsum(nodes[order, 4], axis=1) - nodes[order, 4]
    # A query's own row is among them.
    first = np.zeros(d.shape, bool)
    np.put_along_axis(first, order, before < k + 1, axis=1)
    if score is None:
        i, j = np.nonzero(first)
        reach = np.full(len(q), np.inf)
    else:
        reach = tree.reach(q, score)
        i, j = np.nonzero(~first & (low <= reach[:, None]))
    yield i, j, d[i, j], reach[i]


def asked_pages(queries: DataFrame, tree: Tree, k: int) -> DataFrame:
    """ASKED rows: the pages that each query reads. queries has (id, dim, v), and floor, the score to reach, in the second round."""
    second = "floor" in queries.columns

    def run(batches):
        for b in batches:
            for dim, at, points in _by_dim(b):
                for lo in range(0, len(at), 256):
                    own, q = at[lo : lo + 256], points[lo : lo + 256]
                    score = np.array([-np.inf if x is None else float(x) for x in b.column("floor").take(pa.array(own)).to_pylist()]) if second else None
                    for i, j, here, reach in _nodes_asked(tree, dim, q, k, score):
                        nodes = tree.nodes[dim][j]
                        salts = tree.salts(nodes[:, 4])
                        times = np.repeat(np.arange(len(i)), salts)
                        salt = np.arange(len(times)) - np.repeat(np.cumsum(salts) - salts, salts)
                        for s in range(0, len(times), 4096):
                            t = times[s : s + 4096]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    b.column("id").take(pa.array(own[i[t]])), pa.array(np.full(len(t), dim, np.int32)), pa.array(nodes[t, 0].astype(np.int32)), pa.array(nodes[t, 1].astype(np.int32)),
                                    pa.array(salt[s : s + 4096].astype(np.int32)), pa.array(here[t]), pa.array(reach[t]), _raw_rows(q[i[t]]),
                                ],
                                ["id", "dim", "cell", "ring", "salt", "here", "reach", "v"],
                            )

    return queries.mapInArrow(run, ASKED)


def page_answers(ids: np.ndarray, near: np.ndarray, points: np.ndarray, qid: np.ndarray, here: np.ndarray, reach: np.ndarray, q: np.ndarray, k: int) -> tuple[list[np.ndarray], int]:
    """[query id, id, score] of each query's k best in a page by score, then id, but for its own id; and the products computed.

    An entry is passed over where its parent distance differs from the query's by more than the query's reach.
    """
    order = np.argsort(near, kind="stable")
    ids, near, points = ids[order], near[order], points[order]
    most = float(np.abs(points).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, points.shape[1])
    kind = np.float64 if most < 2**53 else np.int64
    points, out, took = points.astype(kind), [], 0
    turn = np.argsort(here, kind="stable")
    for s in range(0, len(turn), CHUNK):
        t = turn[s : s + CHUNK]
        wide = reach[t].max()
        a, b = np.searchsorted(near, here[t].min() - wide, "left"), np.searchsorted(near, here[t].max() + wide, "right")
        if a == b:
            continue
        score = (q[t].astype(kind) @ points[a:b].T).astype(np.int64)
        took += score.size
        away = (qid[t][:, None] == ids[a:b]) | (np.abs(here[t][:, None] - near[a:b]) > reach[t][:, None])
        worst = -(1 << 62)
        score[away] = worst
        if score.shape[1] > k:
            cut = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            keep = (score >= cut[:, None]) & (score > worst)
        else:
            keep = score > worst
        i, j = np.nonzero(keep)
        # Of equal scores at the cut, the smaller ids.
        best = np.lexsort((ids[a:b][j], -score[i, j], i))
        i, j = i[best], j[best]
        begin = np.searchsorted(i, i, "left")
        top = np.arange(len(i)) - begin < k
        i, j = i[top], j[top]
        out.append(np.column_stack([qid[t][i], ids[a:b][j], score[i, j]]))
    return out, took


def _read(pages: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each asked page's best for each query that asks for it."""
    asked = checkpointed(asked)
    blocks = asked.groupBy(*PAGE_KEY).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = asked.join(blocks, PAGE_KEY).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")).drop("blocks")
    pages = pages.join(blocks, PAGE_KEY).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def answer(page: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: list[np.ndarray] = []
        if len(page) and len(qs):
            dim = int(page["dim"].iloc[0])
            out, _ = page_answers(page["id"].to_numpy(), page["near"].to_numpy(), _matrix(page["v"], dim), qs["id"].to_numpy(), qs["here"].to_numpy(), qs["reach"].to_numpy(), _matrix(qs["v"], dim), k)
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 3), np.int64), columns=["query_id", "vec_id", "score"])

    by = [*PAGE_KEY, "block"]
    return pages.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(answer, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id", scale: int = 256, page: int = PAGE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k highest integer inner products, ties to the smaller id.

    Components become floor(scale * x), of less than 2^26 in size. Vectors that are null or hold null, NaN or infinite
    components take no part; vectors meet those of the same length only; a query meets every row but those of its own id, and
    gets all of them if they are fewer than k. Equal rows count once, rows that share an id but not a vector each for
    themselves, as queries together. Very long vectors are as any. Empty tables give an empty result; other columns are
    ignored, whatever their names.
    """
    rows, asked = prepared(vectors, vector, key, scale), prepared(queries, vector, key, scale)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, lift = rows.agg(F.count("*"), F.max(square)).first()
    # The root's pivots are at most `pivots` vectors, those with the smallest hashes.
    chosen = rows.orderBy(F.xxhash64("id", "v"), "id").limit(max(1, min(pivots, n // page))).select("dim", "v").collect()
    by: dict[int, list] = {}
    for r in chosen:
        by.setdefault(r["dim"], []).append(r["v"])
    tree = Tree(float(lift or 0.0), {d: np.array(sorted(x), np.int64).reshape(len(x), d) for d, x in by.items()}, page)
    pages = checkpointed(paged(checkpointed(routed(rows, tree)), tree))
    first = checkpointed(_best(_read(pages, asked_pages(asked, tree, k), k), k))
    floor = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    more = asked.join(floor, "id", "left").select("id", "dim", "v", "floor")
    found = first.drop("rank").unionByName(_read(pages, asked_pages(more, tree, k), k))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


OP8_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
