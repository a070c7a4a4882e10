"""Repeated substrings: enhanced suffix arrays by anchor, scanned for maximal repeats with all their occurrences.

Every window of `least` bytes has an anchor, its smallest hashed substring of GRAM bytes, the leftmost of equals. Equal windows
have equal anchors, so suffixes that share `least` bytes meet where their anchors are dealt to, whatever documents they are in.
Runs of windows with one anchor travel as one segment. Equal segments are found by the hash of their anchor and a 128-bit digest
of all their bytes: of each kind the earliest goes on, and the others are repeats of it. Segments whose anchor occurs with other contents have their bytes fetched; their
windows are sorted as suffixes, neighbours with common prefixes make intervals, and a stack scan gives the nested intervals.
An interval is a maximal repeat if what stands left of its occurrences differs, or lies outside the segment. Each of its
occurrences but the earliest is covered by an earlier equal string.

An anchor with more than HOT contents, such as a line that many documents have with other text around it, is not sorted in one
task: each of its windows of `least` bytes goes on by itself, to where the digest of the whole window says, and all but the
earliest of equal windows are covered. Equal windows of one task fold before they move.

Tables of segments move as binary columns, a block for each pair of tasks; parts grow in number with the input, and copies
within a batch are folded before they move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import parts_for_bytes, table

LEAST, GRAM = 100, 32
BLOCK = 1 << 20
#: Contents of one anchor above which its windows are dealt out one by one; WIDE marks such segments in their count of windows.
HOT, WIDE = 4096, np.uint16(1 << 15)
SEGMENT = np.dtype([("bucket", "<u8"), ("content", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("home", "<u4"), ("windows", "<u2")])
COVER = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("end", "<u4"), ("home", "<u4")])
KIND_COVER, KIND_SEGMENT, KIND_TEXT, KIND_WINDOW = 0, 1, 2, 3
MOVED = "part int, kind int, rows binary, bytes binary"
NAMES, TYPES = ["part", "kind", "rows", "bytes"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_BYTE = np.random.default_rng(100).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes from each position on."""
    h, width = _BYTE[data], 1
    for step in _STEP:
        h = h[:-width] * step + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, start in data, windows, bucket, digest) of the segments of texts data[bounds[i]:bounds[i + 1]]."""
    wide = LEAST - GRAM + 1
    h = gram_hashes(data) if len(data) >= LEAST else np.zeros(0, np.uint64)
    if len(h) < wide:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))
    # The high bits order by hash, the low ones by place.
    m, width = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64), 1
    while width * 2 <= wide:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < wide:
        m = np.minimum(m[: len(m) - (wide - width)], m[wide - width :])
    anchor = (m & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(np.arange(len(anchor)) + LEAST <= bounds[1:][text[: len(anchor)]])
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))
    text, anchor = text[at], anchor[at]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(at)]
    start, windows = at[first], last - first
    return text[first], start, windows, h[anchor[first]], digests(data, start, windows + LEAST - 1)


def digests(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The 128-bit digests of stretches of data, as two columns. Stretches with one digest are taken to hold the same bytes."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh128_digest
    own = b"".join([digest(view[a:b]) for a, b in zip(start.tolist(), (start + lengths).tolist())])
    return np.frombuffer(own, "<u8").reshape(-1, 2)


def merged(cover: np.ndarray) -> np.ndarray:
    """Covers as maximal runs, sorted by document and start."""
    if len(cover) < 2:
        return cover
    cover = cover[np.lexsort((cover["start"], cover["tag"], cover["doc"]))]
    same = (cover["doc"][1:] == cover["doc"][:-1]) & (cover["tag"][1:] == cover["tag"][:-1])
    group = np.cumsum(np.r_[0, ~same])
    # Ends so far within the document: a running maximum over ends that are lifted document by document.
    lifted = cover["end"].astype(np.int64) + group * (1 << 33)
    reach = np.maximum.accumulate(lifted)
    begin = np.r_[True, cover["start"][1:].astype(np.int64) + group[1:] * (1 << 33) > reach[:-1]]
    out = cover[begin].copy()
    out["end"] = np.maximum.reduceat(cover["end"], np.flatnonzero(begin))
    return out


def folded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal segments the earliest each, in order of bucket and content; and the covers of the others. The same stretch of
    rows that share key and text is no copy of itself."""
    rows = rows[np.lexsort((rows["start"], rows["tag"], rows["doc"], rows["more"], rows["content"], rows["bucket"]))]
    first = np.ones(len(rows), bool)
    for i, c in enumerate(("bucket", "content", "more")):
        differs = rows[c][1:] != rows[c][:-1]
        first[1:] = differs if not i else first[1:] | differs
    head = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
    own = (rows["doc"] == head["doc"]) & (rows["tag"] == head["tag"]) & (rows["start"] == head["start"])
    again = rows[~own]
    cover = np.zeros(len(again), COVER)
    for c in ("doc", "tag", "start", "home"):
        cover[c] = again[c]
    cover["end"] = again["start"] + again["windows"] + LEAST - 1
    return rows[first], merged(cover)


def dealt(rows: np.ndarray, part: np.ndarray, kind: int, data: np.ndarray | None = None, lengths: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of (part, kind, rows, bytes), one for each part that occurs."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    begins = None if lengths is None else np.cumsum(lengths) - lengths
    for block in np.split(order, cut) if len(order) else []:
        raw = b"" if begins is None else b"".join(data[b : b + n].tobytes() for b, n in zip(begins[block].tolist(), lengths[block].tolist()))
        yield int(part[block[0]]), kind, rows[block].tobytes(), raw


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, TYPES)], NAMES)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the bounds of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _scan(parts: int):
    """Documents to segments, dealt by bucket, and covers of the copies within a batch, dealt by document."""

    def blocks(bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(first text, end text, from, to) of blocks of about BLOCK bytes; a longer text comes in overlapping pieces."""
        i = 0
        while i < len(bounds) - 1:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1)
            if bounds[j] - bounds[i] <= BLOCK:
                yield i, j, int(bounds[i]), int(bounds[j])
            else:
                for a in range(int(bounds[i]), int(bounds[j]), BLOCK - LEAST + 1):
                    yield i, j, a, min(a + BLOCK, int(bounds[j]))
            i = j

    def run(batches):
        for b in batches:
            data, bounds = _raw(b.column("body"))
            doc, tag, home = (b.column(c).to_numpy() for c in ("doc", "tag", "part"))
            made = []
            for i, j, lo, hi in blocks(bounds):
                text, start, windows, bucket, content = segments(data[lo:hi], np.clip(bounds[i : j + 1], lo, hi) - lo)
                rows = np.zeros(len(text), SEGMENT)
                text = text + i
                rows["bucket"], rows["content"], rows["more"], rows["windows"] = bucket, content[:, 0], content[:, 1], windows
                rows["doc"], rows["tag"], rows["home"], rows["start"] = doc[text], tag[text], home[text], start + lo - bounds[text]
                made.append(rows)
            rows, cover = folded(np.concatenate(made)) if made else (np.zeros(0, SEGMENT), np.zeros(0, COVER))
            yield _batch([*dealt(rows, (rows["bucket"] % np.uint64(parts)).astype(np.int64), KIND_SEGMENT), *dealt(cover, cover["home"], KIND_COVER)])

    return run


def _gathered(t: pa.Table, kind: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a kind, and their bytes, in order."""
    rows, raw = [], []
    for k, r, d in zip(t.column("kind").to_pylist(), t.column("rows"), t.column("bytes")):
        if k == kind:
            rows.append(np.frombuffer(r.as_py(), dtype))
            raw.append(d.as_py())
    return (np.concatenate(rows) if rows else np.zeros(0, dtype)), np.frombuffer(b"".join(raw), np.uint8)


def _match(hot: int):
    """Folds equal segments of a part; those that share their anchor with other contents go to their documents for their bytes."""

    def run(t: pa.Table) -> pa.Table:
        rows, cover = folded(_gathered(t, KIND_SEGMENT, SEGMENT)[0])
        first = np.flatnonzero(np.r_[True, rows["bucket"][1:] != rows["bucket"][:-1]]) if len(rows) else np.zeros(0, int)
        size = np.diff(np.r_[first, len(rows)])
        size = np.repeat(size, size)
        rows["windows"][size > hot] |= WIDE
        rows = rows[size > 1]
        cover = merged(np.concatenate([cover, _gathered(t, KIND_COVER, COVER)[0]]))
        return _table([*dealt(rows, rows["home"], KIND_SEGMENT), *dealt(cover, cover["home"], KIND_COVER)])

    return run


def single_windows(rows: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The windows of segments that begin at data[begin], each as a segment whose bucket and content are its 128-bit digest."""
    counts = rows["windows"].astype(np.int64)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.repeat(rows, counts)
    out["start"] += offset.astype(np.uint32)
    out["windows"] = 1
    halves = digests(data, np.repeat(begin, counts) + offset, np.full(len(out), LEAST))
    out["bucket"], out["content"], out["more"] = halves[:, 0], halves[:, 1], 0
    return out


def _fetch(parts: int):
    """The bytes of the wanted segments from the documents of a part, dealt by bucket."""

    def run(docs: pa.Table, t: pa.Table) -> pa.Table:
        rows, cover = _gathered(t, KIND_SEGMENT, SEGMENT)[0], _gathered(t, KIND_COVER, COVER)[0]
        out = list(dealt(cover, cover["home"], KIND_COVER))
        if len(rows):
            data, bounds = _raw(docs.column("body"))
            at = {k: b for k, b in zip(zip(docs.column("doc").to_pylist(), docs.column("tag").to_pylist()), bounds[:-1].tolist())}
            # Rows of one document and text may repeat: each stands for all.
            keys = list(zip(rows["doc"].tolist(), rows["tag"].tolist()))
            begin = np.fromiter((at[k] for k in keys), np.int64, len(keys)) + rows["start"]
            wide = rows["windows"] >= WIDE
            if wide.any():
                apart = rows[wide]
                apart["windows"] ^= WIDE
                windows, cover = folded(single_windows(apart, data, begin[wide]))
                out += dealt(windows, (windows["bucket"] % np.uint64(parts)).astype(np.int64), KIND_WINDOW)
                out += dealt(cover, cover["home"], KIND_COVER)
                rows, begin = rows[~wide], begin[~wide]
        if len(rows):
            lengths = rows["windows"].astype(np.int64) + LEAST - 1
            raw = np.concatenate([data[b : b + n] for b, n in zip(begin.tolist(), lengths.tolist())])
            out += dealt(rows, (rows["bucket"] % np.uint64(parts)).astype(np.int64), KIND_TEXT, raw, lengths)
        return _table(out)

    return run


def prefix_ranks(data: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Ranks of the LEAST bytes from each of `windows` on, by doubling the length that is ranked."""
    padded = np.concatenate([data, np.zeros(LEAST, np.uint8)])
    rank = np.zeros(len(data), np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | padded[k : k + len(data)]
    width = 8
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    while width * 2 <= LEAST:
        rank = (rank[: len(rank) - width] << np.uint64(32)) | rank[width:]
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        width *= 2
    return np.unique((rank[windows] << np.uint64(32)) | rank[windows + LEAST - width], return_inverse=True)[1]


def intervals(suffixes: list[bytes], lefts: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(common prefix, members) of the maximal repeats among suffixes that are known to share something: a stack scan.

    lefts: the byte before each suffix, or less than 0 where that is not in sight, which differs from everything.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    common = []
    for a, b in zip(order, order[1:]):
        x, y = suffixes[a], suffixes[b]
        n, lo = min(len(x), len(y)), 0
        if x[:n] == y[:n]:
            lo = n
        else:
            hi = n
            while lo + 1 < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid)
            lo = lo if x[: lo + 1] != y[: lo + 1] else lo + 1
        common.append(lo)
    stack: list[tuple[int, int]] = []
    for i, c in enumerate([*common, -1]):
        begin = i
        while stack and stack[-1][0] > c:
            length, begin = stack.pop()
            members = order[begin : i + 1]
            seen = {lefts[m] for m in members}
            if len(seen) > 1 or min(seen) < 0:
                yield length, members
        if i < len(common) and (not stack or stack[-1][0] < c):
            stack.append((c, begin))


def maximal_repeats(rows: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, segment of each occurrence, offset of each occurrence) of the maximal repeats among segments of one or more
    buckets, whose bytes are in `data`, one after the other."""
    counts = rows["windows"].astype(np.int64)
    lengths = counts + LEAST - 1
    base = np.cumsum(lengths) - lengths
    segment = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = base[segment] + offset
    rank = prefix_ranks(data, place)
    order = np.argsort(rank, kind="stable")
    rank = rank[order]
    same = rank[1:] == rank[:-1]
    begin = np.flatnonzero(np.r_[True, ~same])
    size = np.diff(np.r_[begin, len(order)])
    left = np.where(offset > 0, data[np.maximum(place - 1, 0)].astype(np.int64), -1)[order]
    low, high = np.minimum.reduceat(left, begin), np.maximum.reduceat(left, begin)
    raw, ends = data.tobytes(), base + lengths
    for c in np.flatnonzero((size > 1) & ((low < 0) | (low != high))).tolist():
        at = order[begin[c] : begin[c] + size[c]]
        rest = [raw[p + LEAST : e] for p, e in zip(place[at].tolist(), ends[segment[at]].tolist())]
        for extra, members in intervals(rest, left[begin[c] : begin[c] + size[c]].tolist()):
            chosen = at[members]
            yield LEAST + extra, segment[chosen], offset[chosen]


def _repeats(t: pa.Table) -> pa.Table:
    """Covers from the maximal repeats of a part's segments, and from its single windows: every occurrence but the earliest."""
    rows, data = _gathered(t, KIND_TEXT, SEGMENT)
    found = [_gathered(t, KIND_COVER, COVER)[0], folded(_gathered(t, KIND_WINDOW, SEGMENT)[0])[1]]
    if len(rows):
        for length, segment, offset in maximal_repeats(rows, data):
            own = rows[segment]
            start = own["start"] + offset.astype(np.uint32)
            later = np.lexsort((start, own["tag"], own["doc"]))[1:]
            cover = np.zeros(len(later), COVER)
            for c in ("doc", "tag", "home"):
                cover[c] = own[c][later]
            cover["start"], cover["end"] = start[later], start[later] + length
            found.append(cover)
    cover = merged(np.concatenate(found))
    return _table(list(dealt(cover, cover["home"], KIND_COVER)))


def _cut(docs: pa.Table, t: pa.Table) -> pa.Table:
    """What stays of each document of a part."""
    cover = merged(_gathered(t, KIND_COVER, COVER)[0])
    edge = np.flatnonzero(np.r_[True, (cover["doc"][1:] != cover["doc"][:-1]) | (cover["tag"][1:] != cover["tag"][:-1])]) if len(cover) else np.zeros(0, int)
    runs = {(int(c[0]["doc"]), int(c[0]["tag"])): c for c in (np.split(cover, edge[1:]) if len(edge) else [])}
    out: list[list] = [[] for _ in range(5)]
    for doc, tag, body in zip(docs.column("doc").to_pylist(), docs.column("tag").to_pylist(), docs.column("body")):
        text, at, kept, removed = body.as_py().encode() if isinstance(body.as_py(), str) else body.as_py(), 0, [], 0
        own = runs.get((doc, tag), ())
        for r in own:
            kept.append(text[at : int(r["start"])])
            at = int(r["end"])
            removed += at - int(r["start"])
        kept.append(text[at:])
        for c, v in zip(out, (doc, len(text), removed, len(own), b"".join(kept))):
            c.append(v)
    return pa.table(out, schema=pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row: its bytes without those that a string of LEAST bytes covers which
    also starts earlier, in a smaller key or further to the front of the same text.

    Keys are longs. Null is the empty text; texts shorter than LEAST stay as they are. Rows that share a key but not the text
    are documents of their own, in a fixed order; rows that share both stay alike. Keys of null stay, and come first. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(key).cast("long").alias("own"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    parts = parts_for_bytes(rows, "body", 8)
    rows = rows.select(F.coalesce("own", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("body", F.col("own").isNull()).alias("tag"), "body")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc", "tag"), F.lit(parts)).cast("int"))
    moved = rows.mapInArrow(_scan(parts), MOVED).groupBy("part").applyInArrow(_match(hot), MOVED)
    by_part = rows.groupBy("part")
    moved = by_part.cogroup(moved.groupBy("part")).applyInArrow(_fetch(parts), MOVED).groupBy("part").applyInArrow(_repeats, MOVED)
    out = by_part.cogroup(moved.groupBy("part")).applyInArrow(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("doc") > -(1 << 63), F.col("doc")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its repeated bytes, as counts and a digest."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

