import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pathloom.llm import superkmers as sk


def slow(texts):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + sk.LEAST]) for w in words for i in range(len(w) - sk.LEAST + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - sk.LEAST + 1) if count[tuple(w[i : i + sk.LEAST])] > 1 for j in range(i, i + sk.LEAST)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def made(rng):
    text = lambda n, of=300: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    passages = [text(rng.choice([20, 34, 35, 36, 60, 120])) for _ in range(12)]
    line = text(12)
    texts = [" ".join(rng.choice([passages[rng.randrange(12)], text(rng.randint(0, 60)), line]) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    texts += [texts[5]] * 4 + [None, "", " \n", "a " * 300, "a b " * 100, text(35), text(3000), "é 日本\t" * 40, text(34), passages[4]]
    return [*texts, *(f"{line} {text(40)}" for _ in range(60))]


@pytest.mark.parametrize("size, remember, memory", [(6 << 20, 200_000, 4 << 20), (900, 3, 500)])
def test_matches_the_definition(spark, monkeypatch, size, remember, memory):
    for name, value in (("RUN", size), ("REMEMBER", remember), ("SORTED", memory)):
        monkeypatch.setattr(sk, name, value)
    texts = made(random.Random(13))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, body string, part int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sk.without_repeated_windows(df).collect()}
    for i, want in enumerate(slow(texts)):
        assert got.pop(i) == want, i
    assert not got


def test_frequent_minimisers_give_the_same_windows(spark):
    """A slot that counts as frequent only changes which run of words is a window's minimiser."""
    texts = [(i, i, t.encode()) for i, t in enumerate(filter(None, made(random.Random(14))))]
    one, other = next(sk.pieces(texts, 1 << 20)), next(sk.pieces(texts[::-1], 1 << 20))
    for flags in (None, np.arange(64) % 3 == 0, np.ones(64, bool)):
        windows, again = sk.super_runs(one, flags)[2], sk.super_runs(other, flags)[2]
        assert windows.sum() == sum(max(0, len(t.split()) - sk.LEAST + 1) for _, _, t in texts) and windows.max() <= sk.LEAST - sk.GRAM + 1
        assert Counter(windows.tolist()) == Counter(again.tolist())


def test_blocks_hold_what_was_packed():
    rng = np.random.default_rng(1)
    for n in (0, 1, 300):
        rows = np.zeros(n, sk.STRING)
        rows["bucket"], rows["key"], rows["windows"], rows["covered"] = rng.integers(0, 1 << 62, n), np.arange(n) - 20, np.arange(n) % 32, np.arange(n) % 2
        own, data = sk.unpacked(sk.packed(rows, b"a b c"))
        assert (own == rows).all() and data == b"a b c"


def test_slots_of_a_common_line_are_frequent(spark):
    rng = random.Random(15)
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(i, i, bytearray((" ".join(f"u{rng.random()}" for _ in range(30)) + " " + line + " " + " ".join(f"v{rng.random()}" for _ in range(30))).encode())) for i in range(600)]
    df = spark.createDataFrame(rows, "key long, tag long, body binary")
    flags = sk.frequent_slots(df, 256)
    assert 1 <= flags.sum() <= 256 // sk.FREQUENT


def test_nulls_repeated_rows_and_empty_tables(spark):
    long = " ".join(map(str, range(100)))
    df = spark.createDataFrame([(2, long), (2, long), (2, "other"), (None, None), (None, long + " x"), (3, "z " + " ".join(map(str, range(200, 250))))], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in sk.without_repeated_windows(df).collect())
    assert got == sorted([("2", 100, 100), ("2", 100, 100), ("2", 1, 0), ("None", 0, 0), ("None", 101, 100), ("3", 51, 0)])
    assert sk.without_repeated_windows(df.limit(0)).count() == 0
    assert sk.without_repeated_windows(df.where("doc_id = 3").repartition(4)).count() == 1
