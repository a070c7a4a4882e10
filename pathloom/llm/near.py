"""Near duplicates by the Jaccard similarity of word shingles: SimHash fingerprints that lie close by the grid range join are
candidates, and so are texts that share a seeded min-hash band; each link is checked exactly, once for both.

SimHash alone cannot serve here: at a similarity of 0.8 two 64-bit fingerprints differ in about 10 bits, and no grid is selective
so far out. So a text also has BANDS independently seeded fingerprints, each of ROWS min-hashes; two texts of similarity s share one at
least with the chance 1 - (1 - s ** ROWS) ** BANDS: 0.9993 at 0.8, 0.99999 at 0.85. Either way a pair is a candidate only:
its shingles are compared as sets, so texts that have but a repeated line in common are not linked.

Groups of copies do not become all their pairs: first each member of a cell is compared with one of the cell. Cells whose
members are in different components after that are compared within tasks, by one matrix product of which shingle is in which
set, and only a forest of the links found leaves the task. A cell above TILE members goes as pairs of tiles, in as many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import LocalSets, checkpointed, components, word_runs

SEED = 42
PIECE = 1 << 20
ROWS, BANDS = 6, 24
#: Links need a similarity of NUM / DEN or more.
NUM, DEN = 4, 5
_SEEDS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of one cell that a task compares with each other, and shingles that it looks at together.
TILE, WIDE = 512, 1 << 13
#: Shingles that are min-hashed at once.
SLICE = 1 << 12


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles of n words, words as in simhash(); fewer words make one, no words none."""
    digest, found, tail = xxhash.xxh64_intdigest, [], []
    for words in word_runs((text or "").encode().lower(), PIECE):
        words = tail + words
        if len(words) >= n:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: len(words) - n].tolist()]
            found.append(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())], np.uint64))
            words = words[len(words) - n + 1 :]
        tail = words
    if not found and tail:
        found.append(np.array([digest(b" ".join(tail), SEED)], np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def bands(own: np.ndarray) -> np.ndarray:
    """The BANDS fingerprints of a set of shingles, as signed longs; none of an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), SLICE):
        np.minimum(least, ((own[i : i + SLICE, None] ^ _SEEDS[0]) * _SEEDS[1]).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _digest(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, own) of the texts of the one column: the hash of the shingle set, and the set."""

    def run(batches):
        for b in batches:
            own = [shingles(x.as_py(), shingle) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in own], pa.int64()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], ["node", "own"])

    return rows.mapInArrow(run, "node long, own array<long>")


def marked(rows: DataFrame, shingle: int, fingerprint: Callable[[str | None, int], int]) -> DataFrame:
    """(key, tag, node, fp, bands) of rows (key, tag, text); fp is the text's fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            own = [shingles(x, shingle) for x in texts]
            fp = np.fromiter((fingerprint(x, shingle) for x in texts), np.uint64, len(texts))
            cols = [pa.array([_digest(s) for s in own], pa.int64()), pa.array(fp.view(np.int64)), pa.array([bands(s) for s in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["key", "tag", "node", "fp", "bands"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, tag long, node long, fp long, bands array<long>")


def close_pairs(nodes: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (u, v) of nodes (node, fp) whose fingerprints are equal or linked by `close`: each node with the first of its fingerprint,
    and the first one of a fingerprint with that of the closest it is linked to: two pairs for a node at most. Other links between texts
    that are similar are left to the bands."""
    prints = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(prints, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    first = lambda end: prints.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first"))
    links = close(prints).groupBy("u").agg(F.min_by("v", F.bit_count(F.col("u").bitwiseXOR(F.col("v")))).alias("v"))
    met = links.join(first("u"), "u").join(first("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    return checkpointed(same.union(met).where("u <> v"))


def similar_links(rows: DataFrame, marks: DataFrame, shingle: int, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (u, v) between the nodes of marks, enough to join all candidates whose similarity is NUM / DEN or more.

    rows has (key, tag, text), marks what marked() gives for them; a node is a set of shingles. close gives the links (u, v) between
    the fingerprints of column fp.
    """
    nodes = checkpointed(marks.groupBy("node").agg(F.min(F.struct("key", "tag")).alias("row"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    by_print = close_pairs(nodes.select("node", "fp"), close)
    cells = nodes.select("node", F.explode("bands").alias("cell"))
    # The head of a cell is one of its members, another one in each cell.
    heads = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(F.col("cell"))).alias("head")).where("n > 1")
    cells = checkpointed(cells.join(heads, "cell").select("cell", "node", F.col("head").bitwiseXOR(F.col("cell")).alias("head")))
    # The sets of nodes that meet another one, each from one of its rows.
    met = cells.select("node").union(by_print.select(F.explode(F.array("u", "v")))).distinct()
    wanted = nodes.join(met, "node", "left_semi").select(F.col("row.key").alias("k"), F.col("row.tag").alias("t"))
    rows = rows.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("tag") == F.col("t")), "left_semi")
    sets = checkpointed(_sets(rows.select("text"), shingle).dropDuplicates(["node"]))

    # Candidates of both kinds are checked together, each pair once.
    pairs = by_print.union(cells.select(F.col("node").alias("u"), F.col("head").alias("v")).where("u <> v"))
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    both, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    roots = components(pairs.where(both * (NUM + DEN) >= total * NUM).select("u", "v"))
    cells = cells.drop("head").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = mixed.select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    cells = cells.join(mixed, "cell").withColumn("tile", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("tiles")).cast("int"))
    # Tile t meets itself once and every other tile once; where two tiles meet, only pairs across them count.
    cells = cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        F.xxhash64("cell", F.least("tile", "with"), F.greatest("tile", "with")).alias("cell"), "node", "root", "tile", (F.col("tile") != F.col("with")).alias("cross"),
    )
    met = cells.join(sets, "node").repartition("cell").sortWithinPartitions("cell", "tile", "node")
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(met.select("cell", "node", "root", "tile", "cross", "own").mapInArrow(_cells, "u long, v long"))


def shared(own: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, as a square matrix."""
    flat = np.concatenate(own) if own else np.zeros(0, np.int64)
    member = np.repeat(np.arange(len(own)), [len(x) for x in own])
    kinds, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    twice = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    at, member = twice[at[keep]], member[keep]
    order = np.argsort(at, kind="stable")
    at, member = at[order], member[order]
    out = np.zeros((len(own), len(own)), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, WIDE):
        a, b = np.searchsorted(at, [lo, lo + WIDE])
        holds = np.zeros((len(own), WIDE), np.float32)
        holds[member[a:b], at[a:b] - lo] = 1
        out += holds @ holds.T
    return out


def _forest(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Links (u, v) between the roots of members of one cell that are similar and not in one component yet."""
    if len(x) < 2 or x["root"].nunique() < 2:
        return None
    root, tile, own = x["root"].to_numpy(), x["tile"].to_numpy(), list(x["own"])
    size = np.array([len(s) for s in own], np.float32)
    alike = shared(own) * (NUM + DEN) >= (size[:, None] + size) * NUM
    alike &= root[:, None] != root
    if x["cross"].iloc[0]:
        alike &= tile[:, None] != tile
    i, j = np.nonzero(np.triu(alike, 1))
    if not len(i):
        return None
    kinds, at = np.unique(root, return_inverse=True)
    sets = LocalSets(len(kinds))
    sets.add(at[i], at[j])
    moved = np.flatnonzero(sets.label != np.arange(len(kinds)))
    return kinds[moved], kinds[sets.label[moved]]


def _cells(batches):
    """The forests of cells; a cell's members come together, in order, and may span batches."""
    held = None

    def closed(x: pd.DataFrame):
        for _, one in x.groupby("cell", sort=False):
            if (out := _forest(one)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["u", "v"])

    for b in batches:
        own = b.column("own")
        bounds, flat = own.offsets.to_numpy(), own.values.to_numpy()
        new = b.select(["cell", "node", "root", "tile", "cross"]).to_pandas()
        new["own"] = [flat[a:z].copy() for a, z in zip(bounds[:-1], bounds[1:])]
        held = new if held is None else pd.concat([held, new], ignore_index=True)
        cut = int(np.flatnonzero(held["cell"].to_numpy() != held["cell"].iloc[-1]).max(initial=-1)) + 1
        if cut:
            yield from closed(held.iloc[:cut])
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None:
        yield from closed(held)
