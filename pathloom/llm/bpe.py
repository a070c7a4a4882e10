"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenation of raw bytes.

A text longer than a chunk is cut into chunks that overlap. Each chunk is pre-tokenised on its own, in parallel. Where a
boundary of the chunk before also ends a pre-token of this chunk, both agree from there on: that is where they are stitched,
and the pieces between stitches are encoded in parallel. A chunk's boundaries near its end are taken as true only if the
chunk has met a boundary that no context can move before them: white space after something else. Without a stitch, a
chunk joins the piece before it. Ids are held as binary, little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import table, text_batches

CHUNK = 32_768
OVERLAP = 1_024
#: Words whose ids a task remembers; beyond it forgets them all.
REMEMBER = 60_000
OUT_BYTES = 8 << 20
_ODD = re.compile(r" \s| \Z")


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def _words(path: str) -> list[bytes]:
    """The raw bytes of each id; ids that the file leaves out have none."""
    with open(path, "rb") as f:
        words = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [words.get(i, b"") for i in range(max(words, default=-1) + 1)]


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def space_cuts(text: str) -> list[str]:
    """The parts of a text between the spaces before which no pre-token goes on: those that something other than white space
    follows. All parts but the first belong after a space."""
    if not _ODD.search(text):
        return text.split(" ")
    out: list[str] = []
    for p in text.split(" "):
        if out and (not p or p[0].isspace()):
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def word_encoder(one: Callable[[str], list[int]], remember: int = REMEMBER) -> Callable[[str], bytes]:
    """Encodes texts word by word with `one`, remembering words; exact, as a pre-token never spans the place before a space
    that something other than white space follows."""
    known: dict[str, bytes] = {}

    def ids(s: str) -> bytes:
        return np.array(one(s), "<u4").tobytes()

    def encode(text: str) -> bytes:
        first, *rest = space_cuts(text)
        if len(known) > remember:
            known.clear()
        out = [known.get(p) for p in rest]
        for i, x in enumerate(out):
            if x is None:
                p = rest[i]
                x = known.get(p)
                if x is None:
                    x = ids(" " + p)
                    if len(p) <= 40:
                        known[p] = x
                out[i] = x
        return b"".join((ids(first), *out))

    return encode


def _ordinary(path: str, pattern: str) -> Callable[[str], list[int]]:
    enc = _encoding(path, pattern)

    def one(s: str) -> list[int]:
        try:
            return enc.encode_ordinary(s)
        except BaseException as e:  # the library's own scanner gives up on some very long runs
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return [i for m in regex.finditer(pattern, s) for i in enc._encode_single_piece(m.group())]

    return one


def sized_batches(rows, names: list[str], types: list[pa.DataType], size: int = OUT_BYTES):
    """Record batches of about `size` bytes from an iterator of (bytes of the row, values)."""
    cols, held = [[] for _ in names], 0
    for n, values in rows:
        for c, v in zip(cols, values):
            c.append(v)
        held += n
        if held >= size or len(cols[0]) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
            cols, held = [[] for _ in names], 0
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _encoded(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """The text column replaced by ids."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "text") + ", ids binary"

    def run(batches):
        encode = word_encoder(_ordinary(path, pattern))
        for b in batches:
            keep, text = [i for i, n in enumerate(b.schema.names) if n != "text"], b.column(b.schema.names.index("text"))
            at = 0
            while at < b.num_rows:
                ids, held = [], 0
                while at + len(ids) < b.num_rows and held < OUT_BYTES:
                    ids.append(encode(text[at + len(ids)].as_py() or ""))
                    held += len(ids[-1])
                cols = [b.column(i).slice(at, len(ids)) for i in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())], [*(b.schema.names[i] for i in keep), "ids"])
                at += len(ids)

    return df.mapInArrow(run, schema)


def pretoken_ends(text: str, pattern: str, base: int, first: bool, head: int, tail: int) -> tuple[list[int], list[int]]:
    """Ends of pre-tokens of a chunk at `base`: those in its first `head` characters, and the sure ones from `tail` on.

    Only ends between two ASCII characters count, as tables of character classes may differ beyond them, none after
    white space, which reads what follows, and none at the very end, where that is not in sight.
    """
    heads, tails, sure = [], [], first
    for m in regex.finditer(pattern, text):
        e = m.end()
        if e > len(text) - 4 or text[e - 1] >= "\x80" or text[e] >= "\x80" or text[e - 1].isspace():
            continue
        sure = sure or text[e].isspace()
        if e <= head:
            heads.append(base + e)
        if e >= tail and sure:
            tails.append(base + e)
    return heads, tails


def _stitched(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, key, piece, text): pieces of the long texts that start and end at true pre-token boundaries."""
    n = F.ceil(F.char_length("text") / chunk).cast("int")
    chunks = long.withColumn("row", F.monotonically_increasing_id()).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    chunks = chunks.select(
        "row", "key", "chunk", F.substring("text", F.col("chunk") * chunk + 1, F.lit(chunk + overlap)).alias("text"), (F.col("chunk") == n - 1).alias("last")
    ).repartition("row", "chunk")

    def run(batches):
        for b in batches:
            heads, tails = [], []
            for c, t in zip(b.column("chunk").to_pylist(), b.column("text").to_pylist()):
                h, e = pretoken_ends(t, pattern, c * chunk, c == 0, overlap, chunk)
                heads.append(h)
                tails.append(e)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*b.schema.names, "heads", "tails"]
            )

    key = dict(chunks.dtypes)["key"]
    marked = chunks.mapInArrow(run, f"row long, key {key}, chunk int, text string, last boolean, heads array<long>, tails array<long>")
    order = Window.partitionBy("row").orderBy("chunk")
    met = F.array_min(F.array_intersect("heads", F.lag("tails").over(order)))
    marked = marked.withColumn("from", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(met)).drop("heads", "tails")
    marked = marked.withColumn("piece", F.count("from").over(order)).withColumn("until", F.lead("from").over(order))
    # A chunk without a stitch to the next gives its own part only; the rest of the piece is the next chunk's.
    base = F.col("chunk") * chunk
    start = F.coalesce("from", base.cast("long"))
    end = F.when(F.col("last"), base + F.char_length("text")).otherwise(F.coalesce("until", base + chunk))
    marked = marked.select("row", "key", "piece", "chunk", "text", (start - base).cast("int").alias("skip"), (end - start).cast("int").alias("len"))
    part = marked.select("row", "key", "piece", "chunk", F.col("text").substr(F.col("skip") + 1, F.col("len")).alias("text"))
    return (
        part.groupBy("row", "key", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
        .select("row", "key", "piece", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    )


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids): the ids of each whole text, without special tokens.

    Null is the empty text, which has no ids. Texts longer than `chunk` are cut into chunks that overlap, however long they are.
    Repeated rows and keys give a row each. An empty table gives an empty result.
    Other columns are ignored, whatever their names. The vocabulary is a rank file that each executor finds at `path`.
    """
    if path is None or pattern is None:
        own_path, own_pattern = _vocabulary()
        path, pattern = path or own_path, pattern or own_pattern
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    short = _encoded(rows.where(F.char_length("text") <= chunk), path, pattern)
    pieces = _encoded(_stitched(rows.where(F.char_length("text") > chunk), pattern, chunk, overlap), path, pattern)
    long = pieces.groupBy("row", "key").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p")).select("key", F.expr("aggregate(p, X'', (a, x) -> a || x.ids)").alias("ids"))
    return short.union(long).withColumnRenamed("key", key)


def decode(ids: DataFrame, column: str = "ids", path: str | None = None) -> DataFrame:
    """The table with `column` replaced by the raw bytes that its ids stand for, named `decoded`; null and empty give no bytes."""
    path = path or _vocabulary()[0]
    at = ids.columns.index(column)
    schema = ", ".join("decoded binary" if i == at else f"`{c}` {t}" for i, (c, t) in enumerate(ids.dtypes))

    def run(batches):
        words = _words(path)
        for b in batches:
            a = 0
            while a < b.num_rows:
                out, held = [], 0
                while a + len(out) < b.num_rows and held < OUT_BYTES:
                    raw = b.column(at)[a + len(out)].as_py() or b""
                    out.append(b"".join(map(words.__getitem__, np.frombuffer(raw, "<u4").tolist())))
                    held += len(out[-1])
                cols = [b.column(i).slice(a, len(out)) if i != at else pa.array(out, pa.binary()) for i in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays(cols, ["decoded" if i == at else n for i, n in enumerate(b.schema.names)])
                a += len(out)

    return ids.mapInArrow(run, schema)


def digests(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of (key, ids): counts and SHA-256 of the ids and of the bytes that they decode to."""
    said = ids.select(key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(said).select(key, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the 50k byte-level ranks and decoded again, as counts and digests."""
    return digests(encode(table(spark, sf_dir, "documents")))
