import random

import numpy as np
import pytest
import xxhash

from pathloom.llm import simhash as sh


def slow_fingerprint(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in fps}


def test_fingerprint_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = ["", None, " \t\n", "One", "One two\x0bthree", "é À b  c d E f"] + ["".join(rng.choice("aB \n") for _ in range(200)) for _ in range(50)]
    for size in (7, 1 << 20):
        monkeypatch.setattr(sh, "PIECE", size)
        assert [sh.simhash(t) for t in texts] == [slow_fingerprint(t) for t in texts]


@pytest.mark.parametrize("n", [10, 1 << 21, 1 << 26])
def test_every_close_pair_shares_a_cell(n):
    rng = random.Random(n)
    masks = sh.grid_masks(sh.grid_groups(n, 4), 4)

    def unary(x):
        low, high = x & sh.EVEN, x >> 1 & sh.EVEN
        return low | high | (low & high) << 1

    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for _ in range(4):
            b ^= 1 << rng.randrange(64)
        assert (unary(a) ^ unary(b)).bit_count() <= (a ^ b).bit_count()
        assert any(unary(a) & m == unary(b) & m for m in masks)


@pytest.mark.parametrize("tile", [5, 4096])
def test_components_match_brute_force(spark, tile):
    rng = random.Random(1)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 12])):
            fps.append(x)
            for _ in range(rng.choice([0, 1, 3, 4, 6])):
                x ^= 1 << rng.randrange(64)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    roots = {r.node: r.root for r in sh.components(sh.near_links(df, tile=tile)).collect()}
    got, least = {}, {}
    for i, x in enumerate(signed):
        least.setdefault(roots.get(x, x), i)
        got[i] = least[roots.get(x, x)]
    assert got == slow_components(dict(enumerate(fps)))


def test_edges_of_the_contract(spark):
    rows = [(5, None, 1), (3, "", 2), (9, " \n", 3), (7, "same words in this text here", 4), (8, "same words in this text here", 5), (8, "same words in this text here", 5), (1, "x" * 300_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = {(r.doc_id, r.fingerprint, r.component) for r in sh.near_duplicates(df).collect()}
    assert {(d, c) for d, _, c in got} == {(5, 3), (3, 3), (9, 3), (7, 7), (8, 7), (1, 1)}
    assert sh.near_duplicates(df).count() == 7
    assert sorted(r.doc_id for r in sh.keep_one(df).collect()) == [1, 3, 7]
    assert sh.keep_one(df).columns == df.columns
    assert sh.near_duplicates(df.limit(0)).count() == 0
