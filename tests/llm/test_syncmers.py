import hashlib
import random

from pathloom.llm import syncmers as sy
from pathloom.llm.ranges import range_bounds, range_of
from pyspark.sql import functions as F


def texts():
    rng = random.Random(8)
    words = ["alpha", "be", "gam", "délta", "🙂", "epsilonlong", "z"]
    return [None, "", " \n", "one", "one two", *(" ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(rng.choice([3, 20, 200]))) for _ in range(60)), "y" * 50_000, "w " * 20_000]


def slow_units(t):
    out, held = [], ""
    for c in t or "":
        if c in " \t\n\x0b\f\r":
            out, held = out + [held] * bool(held), ""
        elif c in "o05" or ord(c) >= 128:
            out, held = [*out, held + c], ""
        else:
            held += c
    return out + [held] * bool(held)


def slow_likeness(a, b):
    """Dice's coefficient of what the fingerprints hold."""
    a, b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_likeness_is_that_of_the_whole_fingerprints(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3)
    got = sorted(sy.compared(docs).collect())
    for r, after in zip(got, got[1:] + got[:1]):
        assert abs(r.near_edited - slow_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - slow_likeness(r.fingerprint, after.fingerprint)) < 1e-12


def test_positions_and_insertions(spark):
    rng = random.Random(5)
    t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))  # no space at all
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    swapped = " ".join(words[200:] + words[:200])
    rows = [(0, t), (1, t[:700] + "q" + t[700:]), (2, " ".join(words)), (3, swapped), (4, " ".join(rng.sample(words, 400)))]
    got = {r.doc_id: r for r in sy.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.9 < got[0].near_next < 1 and 0.9 < got[2].near_next < 1 and got[3].near_next < 0.3


def test_edited_texts_and_neighbours(spark):
    rows = [(3 * i + 1, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, body string, n_chars int").repartition(5)
    got = {r.doc_id: r for r in sy.compared(docs).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after, r = t or "", after or "", got[i]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(t.split()) >= 100 and len(set(t.split())) > 50:
            assert r.near_edited > 0.6 and r.near_next < 0.3


def test_anchors_are_closed_syncmers(spark):
    t = texts()[20]
    df = spark.createDataFrame([(t,)], "text string")
    got = [(a.pos, a.hash) for a in df.select(sy.anchors("text").alias("a")).first().a]
    units = slow_units(t)
    h = [r.h for r in spark.createDataFrame([(u,) for u in units], "u string").select(F.xxhash64("u").alias("h")).collect()]
    w = [r.w for r in spark.createDataFrame(list(zip(h, h[1:])), "a long, b long").select(F.xxhash64("a", "b").alias("w")).collect()]
    inner = sy.K - sy.S + 1
    want = [i for i in range(len(w) - inner + 1) if min(w[i : i + inner]) in (w[i], w[i + inner - 1])]
    assert [p for p, _ in got] == want


def test_repeated_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_chars) for r in sy.compared(docs).collect()) == [(1, 5), (1, 5), (2, 1)]
    assert sy.compared(docs.limit(0)).count() == 0


def test_ranges(spark):
    df = spark.range(0, 1000, 7)
    for parts in (1, 5, 140):
        bounds = range_bounds(df, "id", parts)
        got = df.select("id", range_of(F.col("id"), bounds).alias("p")).collect()
        assert all(r.p == sum(b <= r.id for b in bounds) for r in got) and len({r.p for r in got}) == parts
