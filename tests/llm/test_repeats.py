import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from pathloom.llm import repeats as rp


def slow(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        t, gone = texts[k], set()
        for i in range(len(t) - rp.LEAST + 1):
            w = t[i : i + rp.LEAST]
            if w in seen:
                gone.update(range(i, i + rp.LEAST))
            seen.add(w)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out[k] = (len(t), len(gone), spans, bytes(c for i, c in enumerate(t) if i not in gone))
    return out


def made(rng):
    words = ["ab", "cde", "é", "fghi ", "\n", "x", "🙂", "the of "]
    text = lambda n: "".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randint(30, 150)) for _ in range(6)]
    docs = {}
    for i in range(60):
        parts = [rng.choice(passages)[rng.choice([0, 0, 3, 10]) :] if rng.random() < 0.5 else text(rng.randint(0, 40)) for _ in range(rng.randint(1, 6))]
        docs[i] = "".join(parts)
    docs |= {100 + i: docs[5] for i in range(5)} | {200: "", 201: "a" * 700, 202: "a" * 350 + "b" + "a" * 300, 203: "ab" * 400, 204: "\x00" * 260, 205: text(9000), 206: "y" * 99}
    near = list(docs[205])
    for i in range(0, len(near), 137):
        near[i] = "Z"
    return docs | {207: "".join(near)}


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_matches_the_definition(spark, monkeypatch, block):
    monkeypatch.setattr(rp, "BLOCK", block)
    docs = made(random.Random(11))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id long, text string, body string, part int").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rp.without_repeats(df).collect()}
    want = slow({i: t.encode() for i, t in docs.items()})
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == want[i], i


def test_nulls_and_repeated_rows(spark):
    long = "".join(chr(97 + i % 23) + str(i) for i in range(200))
    df = spark.createDataFrame([(2, long), (2, long), (1, None), (None, long), (3, long + "!")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.kept)) for r in rp.without_repeats(df).collect())
    n = len(long)
    assert got == sorted([("None", n, 0, n), ("2", n, n, 0), ("2", n, n, 0), ("1", 0, 0, 0), ("3", n + 1, n, 1)])
    assert rp.without_repeats(df.limit(0)).count() == 0


def test_stack_scan_gives_nested_maximal_repeats():
    found = sorted((n, sorted(m)) for n, m in rp.intervals([b"abc", b"abd", b"a", b"abc"], [1, 2, 3, 1]))
    assert found == [(1, [0, 1, 2, 3]), (2, [0, 1, 3])]
    assert [n for n, _ in rp.intervals([b"xy", b"xy"], [7, 7])] == [] and [n for n, _ in rp.intervals([b"xy", b"xy"], [-1, 7])] == [2]


def test_covers_merge():
    c = np.array([(1, 0, 5, 9, 0), (1, 0, 0, 5, 0), (2, 0, 1, 3, 0), (1, 0, 20, 30, 0), (1, 0, 21, 22, 0), (1, 0, 29, 31, 0)], rp.COVER)
    assert [(int(r["doc"]), int(r["start"]), int(r["end"])) for r in rp.merged(c)] == [(1, 0, 9), (1, 20, 31), (2, 1, 3)]


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_match_the_definition(spark, hot):
    docs = made(random.Random(12))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rp.without_repeats(df, hot=hot).collect()}
    assert got == slow({i: t.encode() for i, t in docs.items()})


def test_a_line_of_many_documents_spreads_over_the_parts():
    rng, line, n, parts = random.Random(4), "".join(random.Random(2).choices("abcdefgh ", k=60)), 600, 8
    around = lambda: "".join(rng.choices("ijklmnop", k=90))
    texts = [around() + line + around() for _ in range(n)]
    docs = pa.table({"doc": list(range(n)), "tag": [0] * n, "part": pa.array([i % parts for i in range(n)], pa.int32()), "body": texts})

    def by_part(tables):
        t = pa.concat_tables(tables)
        return [t.filter(pc.equal(t["part"], p)) for p in range(parts)]

    moved = by_part([pa.Table.from_batches(rp._scan(parts)(docs.to_batches()))])
    moved = by_part([rp._match(100)(t) for t in moved])
    moved = by_part([rp._fetch(parts)(docs.filter(pc.equal(docs["part"], p)), t) for p, t in enumerate(moved)])
    windows = [len(rp._gathered(t, rp.KIND_WINDOW, rp.SEGMENT)[0]) for t in moved]
    assert min(windows) > n and max(windows) < 1.2 * min(windows)
    assert max(len(rp._gathered(t, rp.KIND_TEXT, rp.SEGMENT)[0]) for t in moved) < n / parts


def test_equal_rows_are_no_copies_of_each_other(spark):
    long = "".join(chr(97 + i % 23) + str(i) for i in range(200))
    df = spark.createDataFrame([(2, long), (2, long), (3, long + "!"), (1, "short")], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_removed, len(r.kept)) for r in rp.without_repeats(df).collect())
    n = len(long)
    assert got == [(1, 0, 5), (2, 0, n), (2, 0, n), (3, n, 1)]


def test_clashing_anchor_hashes_cut_nothing_wrong(spark, monkeypatch):
    """With one hash for all anchors every segment meets every other; only equal bytes are removed."""
    monkeypatch.setattr(rp, "gram_hashes", lambda data: np.zeros(max(0, len(data) - rp.GRAM + 1), np.uint64))
    rows = np.zeros(3, rp.SEGMENT)
    rows["bucket"], rows["content"], rows["more"], rows["doc"] = 1, 7, [1, 2, 1], [1, 2, 3]
    first, cover = rp.folded(rows)
    assert len(first) == 2 and cover["doc"].tolist() == [3]
    docs = {k: t.encode() for k, t in list(made(random.Random(3)).items())[:25]}
    data, bounds = np.frombuffer(b"".join(docs.values()), np.uint8), np.cumsum([0, *map(len, docs.values())])
    text, start, windows, bucket, digest = rp.segments(data, bounds)
    assert not bucket.any() and (windows == 1).all()
    rows = np.zeros(len(text), rp.SEGMENT)
    rows["content"], rows["more"], rows["doc"], rows["start"], rows["windows"] = digest[:, 0], digest[:, 1], text, start - bounds[text], 1
    gone = {(int(c["doc"]), i) for c in rp.merged(rp.folded(rows)[1]) for i in range(int(c["start"]), int(c["end"]))}
    want = slow(dict(enumerate(docs.values())))
    assert all(sum(d == k for d, _ in gone) == want[k][1] for k in want)
