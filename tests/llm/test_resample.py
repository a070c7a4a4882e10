import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pathloom.llm import resample as rs


def features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def slow(docs, target, least=20, percent=25, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10_000) / ((s[b] + 1.0) * (n_t + 10_000)))) for b in s}
    out = []
    for key, text in docs:
        own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=repr)


def made(rng):
    vocabulary = ["the", "The", "of", "é", "日本", "x1", "a-b", "Q", "...", "zero\x00byte"] + [f"w{i}" for i in range(200)]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, k=n))
    docs = [(i, rng.choice([text(rng.randint(0, 80)), text(rng.randint(15, 25)), None, "", "?!"])) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(30)] + docs[:40] + [(None, text(40)), (None, text(40)), (None, None), (600, text(9000))]
    return docs, [text(60) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("size", [1 << 21, 200])
def test_matches_plain_loops(spark, monkeypatch, size):
    monkeypatch.setattr(rs, "RUN", size)
    monkeypatch.setattr(rs.feature_runs, "__defaults__", (size,))
    docs, target = made(random.Random(12))
    df = spark.createDataFrame([(k, x, "s", 1) for k, x in docs], "doc_id long, text string, score string, rank int").repartition(6)
    got = rs.resampled(df, spark.createDataFrame([(x,) for x in target], "text string"))
    assert got.columns == ["key", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow(docs, target)


def test_features_of_runs_are_those_of_the_whole():
    texts = [("Ab c-d é " * 50).encode(), b"", b" ", b"one", ("x " * 999).encode()]
    whole, runs = Counter(), Counter()
    for counts, size in ((whole, 1 << 20), (runs, 7)):
        for numbers, bucket in rs.feature_runs(texts, size):
            counts.update(zip(numbers.tolist(), bucket.tolist()))
    assert whole == runs and sum(whole.values()) == sum(len(features(t.decode())) for t in texts)


def test_many_equal_rows_share_a_score(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, text)] * 1000 + [(i, text) for i in range(10, 20)], "doc_id long, text string").repartition(8)
    got = rs.resampled(df, df.limit(1)).collect()
    ranks = sorted(r.rank for r in got if r.rank)
    assert len(got) == 1010 and ranks == list(range(1, 25 * 1010 // 100 + 1))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rs.resampled(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b")], none.schema)
    assert [tuple(r)[:3] for r in rs.resampled(one, none).collect()] == [(1, 3, int(np.floor(1000 * math.log(10_003 / 20_000))))]
