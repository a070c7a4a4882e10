"""Repeated runs of words by super-k-mer partitioning: windows of LEAST words that occur more than once are found exactly.

A window's minimiser is its run of GRAM words with the smallest hash, the leftmost of equals. Consecutive windows with one
minimiser make a super-k-mer: its words, joined by spaces, travel as one packed string to the bucket of the minimiser. Equal
windows have equal minimisers at equal places, so they meet in one bucket, whatever documents they are in; there the windows of
all strings are sorted, which counts them exactly.

Runs of GRAM words that are frequent, as in a line that many documents have, would gather strings of unlike texts in one bucket.
A pass over all texts counts minimisers by slots of their hash; a slot that holds many times its share ranks behind all others,
so that such a run is a window's minimiser only where the window has no other, which is within a longer copied passage. Such
windows make equal strings, and a task sends an equal string twice at most while it remembers it: what it has seen before it
covers itself.

Strings move in blocks, one for each batch and part, compressed. Parts are groups, not partitions: their number grows with the
input, and Spark's sorted shuffle brings one after the other into memory.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.bpe import sized_batches
from pathloom.llm.common import parts_for_bytes, table, text_batches, word_runs

LEAST, GRAM = 35, 4
#: How hard blocks are compressed: they are three times the text and more.
LEVEL = 5
#: Bytes of text whose words are in memory at once, and of packed strings whose windows are.
RUN, SORTED = 6 << 20, 4 << 20
#: Least and most slots that minimisers are counted in; a slot of so many times the mean is frequent.
SLOTS, MOST_SLOTS, FREQUENT = 1 << 12, 1 << 20, 16
#: Strings that a task remembers; beyond it forgets them all.
REMEMBER = 200_000
#: A super-k-mer: its document and first word, how many windows and bytes it has, and whether its sender has covered it.
STRING = np.dtype([("bucket", "<u8"), ("key", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("bytes", "<u4"), ("windows", "u1"), ("covered", "?")])
COVER = np.dtype([("key", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("words", "<u4")])
KIND_STRING, KIND_COVER = 0, 1
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Words:
    """The words of some pieces of texts, as numbers of a vocabulary. A piece is (key, tag, number of its first word)."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.pieces: list[tuple[int, int, int]] = []
        self.codes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, key: int, tag: int, at: int, words: list[bytes], size: int) -> None:
        self.pieces.append((key, tag, at))
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.bytes += size


def pieces(texts: Iterable[tuple[int, int, bytes]], size: int) -> Iterator[Words]:
    """The words of texts (key, tag, body), for about `size` bytes at a time. A longer text's pieces overlap, so that each of its
    windows lies in exactly one. Texts too short for a window are left out."""
    out = Words()
    for key, tag, body in texts:
        at, tail = 0, []
        for run in word_runs(body, size):
            words = tail + run
            more = len(words) - LEAST + 1
            if more > 0:
                out.add(key, tag, at, words, min(len(body), size))
                at, words = at + more, words[more:]
            tail = words
            if out.bytes >= size:
                yield out
                out = Words()
    if out.bytes:
        yield out


def super_runs(group: Words, frequent: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(piece, first word within all words, windows, minimiser's hash) of the super-k-mers of some words. frequent: a flag for
    each slot."""
    sizes = np.array([len(c) for c in group.codes])
    h, width = np.fromiter(map(xxhash.xxh64_intdigest, group.numbers), np.uint64, len(group.numbers))[np.concatenate(group.codes)], 1
    for step in _STEP:
        h = h[:-width] * step + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # High bits order by frequency and hash, the low ones by place.
    order = h >> np.uint64(1)
    if frequent is not None and frequent.any():
        order |= frequent[(h % np.uint64(len(frequent))).astype(np.intp)].astype(np.uint64) << np.uint64(63)
    m = (order & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    wide, width = LEAST - GRAM + 1, 1
    while width * 2 <= wide:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < wide:
        m = np.minimum(m[: len(m) - (wide - width)], m[wide - width :])
    least = (m & np.uint64(0xFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.arange(len(least)) + LEAST <= np.cumsum(sizes)[piece[: len(least)]])
    least, piece = least[at], piece[at]
    cut = np.flatnonzero((least[1:] != least[:-1]) | (piece[1:] != piece[:-1])) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(at)]
    return piece[first], at[first], last - first, h[least[first]]


def _texts(batches) -> Iterator[tuple[int, int, bytes]]:
    for b in batches:
        for key, tag, body in zip(b.column("key").to_pylist(), b.column("tag").to_pylist(), b.column("body")):
            yield key, tag, body.as_py()


def frequent_slots(rows: DataFrame, slots: int) -> np.ndarray:
    """A flag for each slot: whether it holds FREQUENT times its share of all super-k-mers. Such slots are few: at most `slots` by FREQUENT."""

    def run(batches):
        total = np.zeros(slots, np.int64)
        for group in pieces(_texts(batches), RUN):
            total += np.bincount((super_runs(group, None)[3] % np.uint64(slots)).astype(np.intp), minlength=slots)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(total[filled], pa.int64())], ["slot", "n"])

    counts = rows.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # A row for each slot at most: one task sums them up.
    share = counts.select("slot", "n", (F.sum("n").over(Window.partitionBy()) / slots * FREQUENT).alias("limit"))
    flags = np.zeros(slots, bool)
    flags[[r.slot for r in share.where("n > limit").select("slot").collect()]] = True
    return flags


def packed(rows: np.ndarray, strings: bytes) -> bytes:
    """A block of strings, one after the other, and their rows by columns of bytes."""
    return zstandard.compress(len(rows).to_bytes(4, "little") + rows.view(np.uint8).reshape(len(rows), STRING.itemsize).T.tobytes() + strings, LEVEL)


def unpacked(block: bytes) -> tuple[np.ndarray, bytes]:
    """(rows, strings) of a block."""
    data = zstandard.decompress(block)
    n = int.from_bytes(data[:4], "little")
    end = 4 + n * STRING.itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, end - 4, 4).reshape(STRING.itemsize, n).T).view(STRING)[:, 0], data[end:]


def _send(parts: int, frequent: np.ndarray):
    """Blocks of strings and covers, by part."""

    def blocks(group: Words, known: dict[bytes, bool]) -> Iterator[tuple]:
        piece, first, windows, bucket = super_runs(group, frequent)
        codes, words = np.concatenate(group.codes), list(group.numbers)
        # All words, joined by spaces, and where each begins.
        text = b" ".join([words[i] for i in codes.tolist()])
        begin = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))[codes] + 1)]
        a, b = begin[first], begin[first + windows + LEAST - 1] - 1
        base = np.cumsum([len(c) for c in group.codes]) - [len(c) for c in group.codes]
        key, tag, at = (np.array(c, np.int64)[piece] for c in zip(*group.pieces))
        rows = np.zeros(len(piece), STRING)
        rows["bucket"], rows["key"], rows["tag"], rows["start"], rows["windows"], rows["bytes"] = bucket, key, tag, at + first - base[piece], windows, b - a
        # A string's second coming says that there are two; what comes after that need not travel.
        send, covered = np.ones(len(rows), bool), rows["covered"]
        digest = xxhash.xxh128_digest
        for i, s in enumerate(map(digest, map(text.__getitem__, map(slice, a.tolist(), b.tolist())))):
            twice = known.setdefault(s, None)
            if twice is None:
                known[s] = False
            else:
                covered[i] = True
                send[i] = not twice
                known[s] = True
        for kind, chosen, home in ((KIND_STRING, np.flatnonzero(send), bucket), (KIND_COVER, np.flatnonzero(covered), tag.view(np.uint64))):
            part = (home[chosen] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, chosen = part[order], chosen[order]
            for of in np.split(np.arange(len(chosen)), np.flatnonzero(np.diff(part)) + 1) if len(chosen) else []:
                i = chosen[of]
                if kind == KIND_STRING:
                    block = packed(rows[i], b"".join(map(text.__getitem__, map(slice, a[i].tolist(), b[i].tolist()))))
                else:
                    block = _covers(key[i], tag[i], rows["start"][i], windows[i] + LEAST - 1).tobytes()
                yield len(block), (int(part[of[0]]), kind, block)

    def run(batches):
        known: dict[bytes, bool] = {}
        for group in pieces(_texts(batches), RUN):
            if len(known) > REMEMBER:
                known.clear()
            yield from sized_batches(blocks(group, known), ["part", "kind", "block"], [pa.int32(), pa.int32(), pa.binary()])

    return run


def _covers(key, tag, start, words) -> np.ndarray:
    out = np.zeros(len(key), COVER)
    out["key"], out["tag"], out["start"], out["words"] = key, tag, start, words
    return out


def repeated(rows: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Covers of the windows that occur more than once among strings of one part; rows and strings are in one order. Strings that
    their senders have covered need no cover, but make other windows repeated."""
    out = [np.zeros(0, COVER)]
    lengths = rows["windows"].astype(np.int64) + LEAST - 1
    # Strings alone in their bucket are done: within one string no window occurs twice.
    order = np.argsort(rows["bucket"], kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(rows["bucket"][order]) != 0, True])
    some = np.flatnonzero(np.diff(edge) > 1)
    held: list[tuple[bytes, list[int]]] = []
    size = 0
    for a, b in zip(edge[some].tolist(), edge[some + 1].tolist()):
        same: dict[bytes, list[int]] = {}
        for i in order[a:b].tolist():
            same.setdefault(strings[i], []).append(i)
        for s, of in same.items():
            left = [i for i in of if not rows["covered"][i]]
            if left and (len(of) > 1 or len(left) < len(of)):
                own = rows[left]
                out.append(_covers(own["key"], own["tag"], own["start"], lengths[left]))
                left = []
            if len(same) > 1:
                held.append((s, left))
                size += len(s)
        if size >= SORTED:
            out.append(_sorted(rows, held))
            held, size = [], 0
    if held:
        out.append(_sorted(rows, held))
    return np.concatenate(out)


def _windows(s: bytes) -> list[bytes]:
    """A string's windows, in order."""
    begin = list(accumulate(map(len, s.split(b" ")), lambda at, n: at + n + 1, initial=0))
    return [s[a : b - 1] for a, b in zip(begin, begin[LEAST:])]


def _sorted(rows: np.ndarray, strings: list[tuple[bytes, list[int]]]) -> np.ndarray:
    """Covers of repeated windows of distinct strings (bytes, rows that need a cover): all windows sorted."""
    each = [_windows(s) for s, _ in strings]
    counts, windows = np.array(list(map(len, each))), list(chain.from_iterable(each))
    owner, offset = np.repeat(np.arange(len(counts)), counts), np.concatenate([np.arange(n) for n in counts])
    order = sorted(range(len(windows)), key=windows.__getitem__)
    equal = np.fromiter((windows[a] == windows[b] for a, b in zip(order, order[1:])), bool, len(order) - 1)
    found = np.zeros(len(order), bool)
    found[order] = np.r_[equal, False] | np.r_[False, equal]
    at = np.flatnonzero(found)
    if not len(at):
        return np.zeros(0, COVER)
    own, j = owner[at], offset[at]
    begin = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (j[1:] != j[:-1] + 1)])
    last = np.r_[begin[1:], len(at)] - 1
    need = [strings[k][1] for k in own[begin].tolist()]
    times = np.array([len(x) for x in need])
    r = rows[np.array([i for x in need for i in x], np.intp)]
    return _covers(r["key"], r["tag"], r["start"] + np.repeat(j[begin], times), np.repeat(j[last] - j[begin] + LEAST, times))


def _match(t: pa.Table) -> pa.Table:
    """The covers of a part: those that senders know of, and those of its strings' repeated windows."""
    rows, strings, known = [np.zeros(0, STRING)], [], []
    for kind, block in zip(t.column("kind").to_pylist(), t.column("block")):
        if kind == KIND_COVER:
            known.append(np.frombuffer(block.as_py(), COVER))
            continue
        own, data = unpacked(block.as_py())
        end = np.cumsum(own["bytes"].astype(np.int64))
        strings += map(data.__getitem__, map(slice, (end - own["bytes"]).tolist(), end.tolist()))
        rows.append(own)
    cover = np.concatenate([*known, repeated(np.concatenate(rows), strings)])
    return pa.table({c: pa.array(cover[c].astype(np.int64)) for c in COVER.names})


def covers(rows: DataFrame, parts: int) -> DataFrame:
    """(key, tag, start, words): stretches of words of rows (key, tag, body) that repeated windows cover; they overlap and repeat."""
    slots = SLOTS
    while slots < min(FREQUENT * parts, MOST_SLOTS):
        slots *= 2
    moved = rows.mapInArrow(_send(parts, frequent_slots(rows, slots)), "part int, kind int, block binary")
    return moved.groupBy("part").applyInArrow(_match, "key long, tag long, start long, words long")


def _cut(batches):
    """What stays of each row's words, given the stretches that go."""

    def kept(body: bytes, start: np.ndarray, words: np.ndarray):
        digest, n, gone, first = hashlib.sha256(), 0, 0, True
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate((start + words)[order]) if len(order) else start
        for run in word_runs(body, RUN):
            if len(start):
                # A word goes if the last stretch that starts at or before it reaches past it.
                at = np.arange(n, n + len(run))
                i = np.searchsorted(start, at, "right") - 1
                stays = (i < 0) | (end[np.maximum(i, 0)] <= at)
                left = [run[j] for j in np.flatnonzero(stays).tolist()]
            else:
                left = run
            n, gone = n + len(run), gone + len(run) - len(left)
            if left:
                digest.update((b"" if first else b" ") + b" ".join(left))
                first = False
        return n, gone, digest.hexdigest()

    for b in batches:
        out = [[], [], []]
        for body, cover in zip(b.column("body"), b.column("cover")):
            stretches = cover.values
            start, words = (np.array(stretches.field(c), np.int64) for c in ("start", "words")) if stretches is not None else (np.zeros(0, np.int64),) * 2
            for c, v in zip(out, kept(body.as_py(), start, words)):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column("own"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string())))], ["own", "n_words", "n_removed", "kept_sha256"])


def without_repeated_windows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row: its words without those of windows of LEAST words that occur anywhere
    else, in another row or at another place of the same. All occurrences go, the first as well.

    Keys are longs, and may be null. A null text has no words; texts of fewer than LEAST words stay as they are. Rows that repeat,
    or share a key, are documents of their own, so equal rows cover each other. Very long texts are read in overlapping pieces.
    An empty table gives an empty result; other columns are ignored, whatever their names. Texts of one key are told apart by a
    64-bit hash, and a sending task takes strings of equal 128-bit digests as equal; strings of different tasks are
    compared byte by byte.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("own"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))
    parts = parts_for_bytes(rows, "body", 8)
    rows = rows.select("own", F.coalesce("own", F.lit(-(1 << 63))).alias("key"), F.xxhash64("body", F.col("own").isNull()).alias("tag"), "body")
    found = covers(rows.select("key", "tag", "body"), parts)
    # Sets, since rows that repeat have the same stretches; a document's stretches are no more than its words.
    found = found.groupBy("key", "tag").agg(F.collect_set(F.struct("start", "words")).alias("cover"))
    out = rows.join(found, ["key", "tag"], "left").select("own", "body", "cover")
    return out.mapInArrow(_cut, "own long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("own", key)


def op13_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without windows of words that occur more than once, as counts and a digest."""
    return without_repeated_windows(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35
), windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts JOIN texts USING (r)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM twice) GROUP BY r
), kept AS (
  SELECT doc_id, w, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS k
  FROM texts LEFT JOIN gone USING (r)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
