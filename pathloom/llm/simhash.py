"""SimHash near-duplicate groups: segment-popcount embedding, grid range-join, exact check.

A 64-bit fingerprint maps to the bit counts of its segments of two bits, 32 coordinates of 0 to 2. The Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints. Embeddings are held in unary: a segment's bits, sorted,
so the Manhattan distance of two embeddings is the bit count of the XOR of their unary words.

The range join lays grids over groups of coordinates: with distance d and g groups, at least g - d groups agree exactly, so
cells are the values of every choice of g - d groups. Pairs that meet in a cell pass the Manhattan bound, then the exact test.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import LocalSets, checkpointed, components, fresh, table, text_batches, word_runs
from pathloom.llm.near import marked, similar_links

SEED = 42
#: Rows of one cell that a task compares with each other; larger cells are dealt out as pairs of tiles.
TILE = 4096
PIECE = 1 << 20
EVEN = 0x5555555555555555


def simhash(text: str | None, n: int = 4) -> int:
    """The fingerprint of a text: words are runs of bytes other than ASCII white space, A-Z in lower case; null is empty.

    Shingles of n words count as often as they occur; fewer words make one shingle; no words give 0.
    """
    digest, ones, total, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []

    def count(hashes: list[int]) -> None:
        nonlocal total
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)

    for words in word_runs((text or "").encode().lower(), PIECE):
        words = tail + words
        if len(words) >= n:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: len(words) - n].tolist()]
            count([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())])
            words = words[len(words) - n + 1 :]
        tail = words
    if not total and tail:
        count([digest(b" ".join(tail), SEED)])
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((simhash(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    text_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def unary(fp):
    """The embedding as one word: in each two-bit segment the ones moved to the low end."""
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid_masks(groups: int, distance: int) -> list[int]:
    """The bits of the unary word that each grid looks at."""
    bounds = [2 * (32 * i // groups) for i in range(groups + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(bounds)]
    return [sum(c) for c in itertools.combinations(masks, groups - distance)]


def grid_groups(n: int, distance: int) -> int:
    """Groups of coordinates for n fingerprints: more and finer grids as n grows; every choice finds all pairs."""
    return distance + (2 if n < 1 << 20 else 3 if n < 1 << 25 else 4)


def _links(distance: int):
    """Per cell, the links of its members as a forest of (u, v); cells come together, in order, and may span batches."""

    def close(x: pd.DataFrame) -> pd.DataFrame | None:
        if len(x) < 2:
            return None
        cell, tile, cross = x["cell"].to_numpy(), x["tile"].to_numpy(), x["cross"].to_numpy()
        fp, emb = x["fp"].to_numpy().view(np.uint64), x["emb"].to_numpy().view(np.uint64)
        sets, at = LocalSets(len(x)), np.arange(len(x) - 1)
        for d in range(1, len(x)):
            at = at[: np.searchsorted(at, len(x) - d)]
            at = at[cell[at] == cell[at + d]]
            if not len(at):
                break
            i = at[~(cross[at] & (tile[at] == tile[at + d]))]
            i = i[np.bitwise_count(emb[i] ^ emb[i + d]) <= distance]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
            if len(i):
                sets.add(i, i + d)
        moved = np.flatnonzero(sets.label != np.arange(len(x)))
        return pd.DataFrame({"u": fp[moved].view(np.int64), "v": fp[sets.label[moved]].view(np.int64)}) if len(moved) else None

    def run(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            cut = int(np.flatnonzero(held["cell"].to_numpy() != held["cell"].iloc[-1]).max(initial=-1)) + 1
            if cut:
                if (out := close(held.iloc[:cut])) is not None:
                    yield out
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and (out := close(held)) is not None:
            yield out

    return run


def near_links(fps: DataFrame, distance: int = 4, tile: int = TILE) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of column fp, enough to join all that lie within `distance` bits.

    Nothing is left out: each pair within the distance meets in a cell of some grid. Only a forest of each cell's links is
    returned. A cell with more than `tile` fingerprints is compared as pairs of tiles, in as many tasks.
    """
    fps = fps.select("fp").distinct()
    masks = [_signed(m) for m in grid_masks(grid_groups(fps.count(), distance), distance)]
    emb = F.col("emb")
    cells = fps.withColumn("emb", unary(F.col("fp"))).select(
        "fp", "emb", F.explode(F.array(*(F.xxhash64(F.lit(i), emb.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))).alias("cell")
    )
    big = cells.groupBy("cell").count().where(F.col("count") > tile).select("cell", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    cells = cells.join(big, "cell", "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("tiles")).cast("int"), F.lit(0)))
    partners = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    # Tile t meets itself once and every other tile once; where two tiles meet, only pairs across them count.
    cells = cells.withColumn("with", F.explode(partners)).select(
        F.when(F.col("tiles").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("tile", "with"), F.greatest("tile", "with"))).alias("cell"),
        "fp", "emb", "tile", (F.col("tiles").isNotNull() & (F.col("tile") != F.col("with"))).alias("cross"),
    )
    return cells.repartition("cell").sortWithinPartitions("cell", "tile", "fp").mapInPandas(_links(distance), "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(key, fingerprint, component): each row's fingerprint in hex and the smallest key that near-duplicate links reach.

    Null and empty texts have fingerprint zero and are linked like any other; equal rows share a component; an empty table
    gives an empty result; other columns are ignored, whatever their names. Very long texts are read in pieces. Keys of null are kept, and are their component
    only if all keys of the component are null.
    """
    fp = checkpointed(fingerprints(docs, text, key, shingle))
    nodes = fp.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(near_links(nodes, distance))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    nodes = nodes.join(least, "root").select("fp", "component")
    return fp.join(nodes, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5) -> DataFrame:
    """The documents, one of each near-duplicate group: the row of the group's smallest key (of equal rows with that key, one).

    Rows are told apart by key and text, so rows that share a key but not a group, or have none, stand for themselves; a row
    without a key is the last of its group. Columns stay as they are. Near duplicates here are texts whose sets of shingles have a Jaccard similarity of 0.8 or more,
    found by near_links of their fingerprints and by min-hash bands, and groups are what links between them reach; texts without words, null ones too, are alike. Very long texts have all their
    shingles. An empty table stays empty.
    """
    text_batches(docs.sparkSession)
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("tag"), body.alias("text"))
    marks = checkpointed(marked(rows, shingle, simhash))
    marks = marks.join(components(similar_links(rows, marks, shingle, near_links)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    on, tag = fresh(docs, "key"), fresh(docs, "tag")
    # Null keys are a text of their own, so that what the join has dealt out by key and tag is not dealt out again.
    known = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    first = marks.groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "tag")).alias("first"))
    first = first.select(known(F.col("first.key")).alias(on), F.col("first.tag").alias(tag))
    return docs.withColumns({on: known(F.col(key)), tag: F.xxhash64(body)}).join(first, [on, tag], "left_semi").dropDuplicates([on, tag]).drop(on, tag)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its near-duplicate component: 4-word shingles, 4 differing bits at most."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")
