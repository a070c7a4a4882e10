import random

from pathloom.llm import mixing as mx


def made(rng):
    rows = []
    for i in range(800):
        source = rng.choice(["big", "big", "big", "b", "é", "", None])
        rows.append((i, " ".join("w" * rng.randint(1, 50)) if rng.random() < 0.9 else rng.choice([None, "", " \n"]), source, "x", 5))
    return [*rows, *rows[:20], (10_000, "w\t" * 60_000, "long", "x", 5), (10_001, "a b", "tiny", "x", 5)]


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_copies(spark):
    rows = made(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, copies int")
    got = mx.mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = slow_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(60 if s != "long" else 60_000, 0.02 * want[s])
    again = mx.mixed(docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    out = mx.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.copies) for r in mx.mixed(docs).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert mx.mix(docs.limit(0)).count() == 0


def test_names_that_the_mix_uses_itself(spark):
    rows = [(i, "w " * (i % 7), "ab"[i % 2], i, i, i, i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, class int, lot int, rank int, copies int")
    plain = docs.select("doc_id", "text", "source")
    key = lambda df: sorted((r.doc_id, r["size"], r.copies) for r in df.collect())
    assert key(mx.mixed(docs)) == key(mx.mixed(plain))
    out = mx.mix(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
