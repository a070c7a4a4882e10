"""Token ids on disk, compressed by a grammar: Re-Pair with random-access decoding.

Documents lie in ascending order of their keys, in blocks of whole documents. A block's ids, each document's closed by the end
id, are one sequence. Frequent pairs of symbols are replaced by new symbols, again and again; what is stored is the rules, the
rest of the sequence, and how many ids each rule expands to. With running sums over those lengths any stretch of ids can be
found and expanded without the rest.

File format: a folder of Parquet files, part-00000 and on, in ascending order of the documents' keys, with a row for each block:
file int, block long, docs long, tokens long, before long (ids of the file's earlier blocks), data binary. data, all little-endian: the magic b"RPR1"; unsigned 32-bit: base (symbols below are ids), rules r,
sequence length n, documents d; r pairs of 32-bit symbols; r 32-bit expansion lengths; n 32-bit symbols; d 64-bit keys; d
64-bit token counts.
"""

from __future__ import annotations

import functools
import gc
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.bpe import sized_batches, space_cuts
from pathloom.llm.common import parts_for_bytes, shared_folder, table, text_batches

END = 0
#: Words whose ids a task remembers, about 250 MB; beyond it forgets them all.
REMEMBER = 1_200_000
#: Letters of a word above which it isn't remembered.
LONG = 40
# Fixed value: the pre-token pattern of byte-level vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A block takes further documents until it holds so many ids.
BLOCK_TOKENS = 1 << 20
#: Least count of a pair, pairs of a round, and the share by which a round must shorten the sequence for another to follow.
LEAST, EACH, GAIN = 16, 4_096, 0.05
#: So many files at most; a file is written as it is read, so its size is no task's memory.
MOST_FILES = 100_000
#: Ids that the rules of a block may stand for in all, to be expanded at once.
FLAT = 1 << 22
MAGIC = b"RPR1"


def _frequent(pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that occur `least` times or more, most frequent first, and their counts."""
    pair = np.sort(pair)
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    count = np.diff(np.r_[first, len(pair)])
    often = np.flatnonzero(count >= least)
    often = often[np.argsort(-count[often], kind="stable")]
    return pair[first[often]], count[often]


def _slots(pair: np.ndarray) -> np.ndarray:
    """A slot of a table of 2^16 for each pair."""
    return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.intp)


def _chosen(pair: np.ndarray, count: np.ndarray, each: int) -> np.ndarray:
    """The first pairs of which none shares a symbol's side or a slot with another, at most `each`: they can't overlap in the
    sequence, but for a symbol with itself. What is left out comes in a later round."""
    out, lefts, rights, slots = [], set(), set(), set()
    for p, slot in zip(pair.tolist(), _slots(pair).tolist()):
        a, b = p >> 32, p & 0xFFFFFFFF
        if a not in rights and b not in lefts and (a != b or a not in lefts) and slot not in slots:
            out.append(p)
            lefts.add(a)
            rights.add(b)
            slots.add(slot)
            if len(out) == each:
                break
    return np.array(out, np.int64)


def compress(ids: np.ndarray, base: int, least: int = LEAST, each: int = EACH, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): the grammar of ids below base. Each round counts all neighbours by one sort and replaces the most
    frequent pairs, at most `each`, left to right. It ends when no pair occurs `least` times or a round has shortened the
    sequence by less than the share `gain`, which is when it costs more than it saves."""
    seq, rules = ids.astype(np.int64), np.zeros((0, 2), np.int64)
    while len(seq) > 1:
        before = len(seq)
        pair = (seq[:-1] << 32) | seq[1:]
        new = _chosen(*_frequent(pair, least), each)
        if not len(new):
            break
        known, number = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64)
        known[_slots(new)], number[_slots(new)] = new, base + len(rules) + np.arange(len(new))
        slot = _slots(pair)
        place = np.flatnonzero(known[slot] == pair)
        # A run of hits one after the other, as of one symbol with itself, is taken every second time.
        begin = np.r_[True, np.diff(place) > 1]
        first = np.maximum.accumulate(np.where(begin, place, 0))
        place = place[(place - first) % 2 == 0]
        seq[place] = number[slot[place]]
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        seq, rules = seq[stay], np.concatenate([rules, np.column_stack([new >> 32, new & 0xFFFFFFFF])])
        if before - len(seq) < gain * before:
            break
    return rules, seq


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; rules use ids and earlier rules only."""
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


def expand(rules: np.ndarray, seq: np.ndarray, base: int) -> np.ndarray:
    """The ids that a sequence stands for, rule level by rule level."""
    while len(seq) and (seq >= base).any():
        big = seq >= base
        width = 1 + big
        end = np.cumsum(width)
        out = np.empty(int(end[-1]), np.int64)
        out[end - width] = np.where(big, rules[np.where(big, seq - base, 0), 0] if len(rules) else 0, seq)
        out[end[big] - 1] = rules[seq[big] - base, 1]
        seq = out
    return seq


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, start): what each rule stands for, one after the other, and where each begins."""
    start = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), np.uint32)
    for i, ((a, b), at) in enumerate(zip(rules.tolist(), start.tolist())):
        end = at + int(lengths[i])
        for x in (a, b):
            if x < base:
                out[at] = x
                at += 1
            else:
                own, begin = int(lengths[x - base]), int(start[x - base])
                out[at : at + own] = out[begin : begin + own]
                at += own
        assert at == end
    return out, start


def pack(keys: list[int], counts: list[int], ids: np.ndarray, base: int) -> bytes:
    rules, seq = compress(ids, base)
    head = MAGIC + struct.pack("<4I", base, len(rules), len(seq), len(keys))
    parts = (rules.astype("<u4"), expansion_lengths(rules, base).astype("<u4"), seq.astype("<u4"), np.array(keys, "<i8"), np.array(counts, "<i8"))
    return head + b"".join(p.tobytes() for p in parts)


class Block:
    """A block as read: documents by number, any stretch of ids without the rest."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of this format")
        self.base, r, n, d = struct.unpack_from("<4I", data, 4)
        at = 20

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * r).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", r).astype(np.int64)
        self.seq = take("<u4", n).astype(np.int64)
        self.keys, self.counts = take("<i8", d), take("<i8", d)
        self.ends = np.cumsum(np.where(self.seq >= self.base, self.lengths[np.where(self.seq >= self.base, self.seq - self.base, 0)] if r else 1, 1))

        # All rules' expansions are kept where they are small, as they are but where long stretches repeat.
        self.flat = expansions(self.rules, self.lengths, self.base) if self.lengths.sum() <= FLAT else None

    def _expanded(self, a: int, b: int) -> np.ndarray:
        """What symbols a to b of the sequence stand for."""
        seq = self.seq[a:b]
        if self.flat is None:
            return expand(self.rules, seq, self.base)
        ids, begin = self.flat
        big = seq >= self.base
        place = np.where(big, seq - self.base, 0)
        width = np.where(big, self.lengths[place], 1) if len(ids) else np.ones(len(seq), np.int64)
        end = np.cumsum(width)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
        out[end[~big] - 1] = seq[~big]
        if big.any():
            width, end, place = width[big], end[big], place[big]
            step = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
            out[np.repeat(end - width, width) + step] = ids[np.repeat(begin[place], width) + step]
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the symbols that cover them."""
        if stop <= start:
            return np.zeros(0, np.int64)
        a, b = int(np.searchsorted(self.ends, start, "right")), int(np.searchsorted(self.ends, stop, "left")) + 1
        skip = start - (int(self.ends[a - 1]) if a else 0)
        return self._expanded(a, b)[skip : skip + stop - start]

    def documents(self, about: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
        """(key, ids) of each document, expanding about so many ids at a time."""
        ends = np.cumsum(self.counts)
        i = 0
        while i < len(ends):
            start = int(ends[i] - self.counts[i])
            j = max(i + 1, int(np.searchsorted(ends, start + about, "right")))
            ids = self.ids(start, int(ends[j - 1]))
            for k in range(i, j):
                yield int(self.keys[k]), ids[int(ends[k] - self.counts[k]) - start : int(ends[k]) - start]
            i = j


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[Callable[[str], bytes], int]:
    """Encodes a text as the library does, and the size of its vocabulary.

    The library's model merges one pre-token at a time; each distinct word is handed to it once, cut into pre-tokens by
    the vocabulary's pattern. Files of another kind (other normalizer or pre-tokenizer) go through the library whole.
    """
    t = _tokenizer(path)
    with open(path) as f:
        config = json.load(f)
    special, before = [x["content"] for x in config["added_tokens"]], config["pre_tokenizer"] or {}
    plain = config["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain:
        return (lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()), t.get_vocab_size(with_added_tokens=True)
    merge, letters, pieces = t.model.tokenize, _byte_letters(), regex.compile(PIECES)

    class Known(dict):
        """The ids of words with the space before them; a word that is asked for and not there is merged."""

        def __missing__(self, s: str) -> bytes:
            out = word(s)
            if len(s) <= LONG:
                self[s] = out
            return out

    known = Known()
    space, number = letters[0x20], attrgetter("id")

    def merged(letters_: str) -> bytes:
        return array("I", map(number, merge(letters_))).tobytes()

    def piece(s: str) -> bytes:
        return merged((s if s.isascii() else s.encode().decode("latin-1")).translate(letters))

    #: The ids of pieces that no space precedes, and of words as they come after a space.
    parts: dict[str, bytes] = {}

    def part(s: str) -> bytes:
        out = parts.get(s)
        if out is None:
            out = piece(s)
            if len(s) <= LONG:
                parts[s] = out
        return out

    def letters_only(s: str) -> bytes:
        """The ids of a word of letters with the space before it."""
        return merged(space + s) if s.isascii() else piece(" " + s)

    def word(s: str) -> bytes:
        """The ids of a word with the space before it."""
        if s.isalpha():
            return letters_only(s)
        head = s[:-1]
        if head.isalpha():
            return known[head] + part(s[-1])
        first, *rest = pieces.findall(" " + s)
        return b"".join((known[first[1:]] if first[1:].isalpha() else part(first), *map(part, rest)))

    def encode(text: str) -> bytes:
        # A special token's string in a text may lie across words.
        if any(s in text for s in special):
            return np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(known) + len(parts) > REMEMBER:
            known.clear()
            parts.clear()
        first, *rest = space_cuts(text)
        return b"".join((*map(piece, pieces.findall(first)), *map(known.__getitem__, rest)))

    return encode, t.get_vocab_size(with_added_tokens=True)


def write_ids(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", path: str | None = None, end: int = END) -> None:
    """Write the ids of every whole text, each closed by the end id, in ascending order of the keys, in this module's format.

    Keys are longs; null keys come first, as the least long. Null is the empty text, which is its end id alone. Very long texts
    are one document of one block, however many ids they have. Rows that share a key are in the order of their texts' hashes.
    An empty table gives a folder without blocks. Other columns are ignored, whatever their names.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("tag", F.xxhash64("body"))
    # Ranges in order, so the files are: partition i writes file i.
    ordered = rows.repartitionByRange(min(parts_for_bytes(rows, "body", 16), MOST_FILES), "key", "tag").sortWithinPartitions("key", "tag", "body")
    ordered = ordered.select(F.spark_partition_id().alias("file"), "key", "body")

    def run(batches):
        encode, base = _encoder(path)
        closing = struct.pack("<I", end)
        keys: list[int] = []
        counts: list[int] = []
        held: list[bytes] = []
        file, block, before, tokens = 0, 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, before, tokens
            if keys:
                data = pack(keys, counts, np.frombuffer(b"".join(held), "<u4"), base)
                numbers = [pa.array([x], pa.int64()) for x in (block, len(keys), tokens, before)]
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), *numbers, pa.array([data], pa.binary())], ["file", "block", "docs", "tokens", "before", "data"])
                block, before, tokens = block + 1, before + tokens, 0
                for x in (keys, counts, held):
                    x.clear()

        for b in batches:
            for file, k, body in zip(b.column("file").to_pylist(), b.column("key").to_pylist(), b.column("body")):
                ids = encode(body.as_py()) + closing
                keys.append(k)
                counts.append(len(ids) // 4)
                held.append(ids)
                tokens += counts[-1]
                if tokens >= BLOCK_TOKENS:
                    yield from flush()
        yield from flush()

    def without_cycles(batches):
        # Millions of small objects, none of them in cycles, which the collector would look for all the time.
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    text_batches(docs.sparkSession)
    ordered.mapInArrow(without_cycles, "file int, block long, docs long, tokens long, before long, data binary").write.mode("overwrite").parquet(folder)


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """(start, data): a folder's blocks, start being how many ids lie before one."""
    blocks = spark.read.parquet(folder)
    files = blocks.groupBy("file").agg(F.sum("tokens").alias("n"))
    # A row for each file, of which there are MOST_FILES at most: one task sums them up, and every task may hold them.
    files = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before_file"))
    return blocks.join(F.broadcast(files), "file").select((F.col("before_file") + F.col("before")).alias("start"), "data")


def _documents(batches) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, start, ids) of every document of batches of placed blocks."""
    for b in batches:
        for start, data in zip(b.column("start").to_pylist(), b.column("data")):
            for k, ids in Block(data.as_py()).documents():
                yield k, start, ids.astype("<u4", copy=False)
                start += len(ids)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids): every document of a folder, start being how many ids lie before it; ids as binary."""

    def run(batches):
        rows = ((4 * len(ids), (k, start, len(ids), ids.tobytes())) for k, start, ids in _documents(batches))
        yield from sized_batches(rows, ["key", "start", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    return _placed(spark, folder).mapInArrow(run, "key long, start long, n_tokens long, ids binary")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32): the same with the checksum of the ids' bytes in their place."""

    def run(batches):
        rows = ((32, (k, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)))) for k, start, ids in _documents(batches))
        yield from sized_batches(rows, ["key", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4)

    return _placed(spark, folder).mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def op9_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and the checksum of its ids, as written to files in the shared folder and read back from them."""
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), folder)
    read = read_checksums(spark, folder)
    return read.select(F.when(F.col("key") > -(1 << 63), F.col("key")).alias("doc_id"), "start", "n_tokens", "ids_crc32")
