import itertools
import random

from pathloom.llm import common, near
from pathloom.llm import simhash as sh


def slow_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def likeness(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


def test_recall_of_the_bands_against_brute_force():
    rng, pairs = random.Random(5), 0
    for _ in range(2000):
        words = [f"w{rng.random()}" for _ in range(rng.randint(60, 300))]
        a, b = (" ".join(x) for x in (words, edited(rng, words, rng.randint(1, max(1, len(words) // 45)))))
        if 0.8 <= likeness(slow_set(a), slow_set(b)) <= 0.95:
            pairs += 1
            assert set(near.bands(near.shingles(a)).tolist()) & set(near.bands(near.shingles(b)).tolist())
    assert pairs > 1000


def test_one_of_each_group_by_brute_force(spark):
    rng, texts = random.Random(8), []
    line = "this one line is repeated"
    for _ in range(30):
        words = [f"w{rng.random()}" for _ in range(rng.randint(40, 200))]
        for _ in range(rng.choice([1, 2, 6])):
            texts.append(" ".join(words))
            words = edited(rng, words, rng.randint(1, max(1, len(words) // 30)))
    texts += [f"{(line + ' ') * 40}{' '.join(f'x{rng.random()}' for _ in range(60))}" for _ in range(5)]
    sets, root = [slow_set(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if likeness(sets[i], sets[j]) >= 0.8:
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in sh.keep_one(df).collect()) == sorted(set(root))


def test_rows_without_a_key_and_keys_of_several_groups(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(20))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (4, text("c")), (7, text("d")), (7, text("e")), (5, text("e")), (7, text("f")), (7, text("f"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sh.keep_one(df)
    want = [(None, text("a")), (None, text("b")), (4, text("c")), (7, text("d")), (5, text("e")), (7, text("f"))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and got.columns == df.columns


def test_a_large_group_of_half_alike_texts(spark, monkeypatch):
    """Many texts that meet in the same cells, most pairs below the limit: links are exact, and in tiles as well."""
    rng, base = random.Random(4), [f"w{i}" for i in range(60)]
    texts = [" ".join(edited(rng, base, rng.choice([1, 2, 3]))) for _ in range(70)]
    sets, root = [slow_set(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if likeness(sets[i], sets[j]) >= 0.8:
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 3 < len(set(root)) < 65
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for tile in (512, 16):
        monkeypatch.setattr(near, "TILE", tile)
        assert sorted(r.doc_id for r in sh.keep_one(df).collect()) == sorted(set(root))


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(near, "WIDE", 7)
    rng = random.Random(6)
    own = [sorted(rng.sample(range(60), rng.randint(0, 30))) for _ in range(20)]
    got = near.shared([near.np.array(x, near.np.int64) for x in own])
    assert all(got[i, j] == len(set(own[i]) & set(own[j])) for i in range(20) for j in range(20) if i != j)


def test_fingerprints_meet_in_the_grid_before_bands(spark, monkeypatch):
    """Without any band, equal and close fingerprints alone link what is similar; unlike texts of close fingerprints stay apart."""
    rng = random.Random(9)
    words = [f"w{rng.random()}" for _ in range(3000)]
    other, line = [f"v{i}" for i in range(50)], "this one line is repeated"
    texts = [" ".join(words), " ".join(edited(rng, words, 1)), " ".join(other), " ".join([*other, *other[:4]])]
    texts += [f"{(line + ' ') * 40}{' '.join(f'x{rng.random()}' for _ in range(20))}" for _ in range(3)]
    prints = [sh.simhash(t, 5) for t in texts]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= 4 or prints[0] == prints[1]
    assert all((a ^ b).bit_count() <= 4 for a, b in itertools.combinations(prints[4:], 2))
    monkeypatch.setattr(near, "bands", lambda own: near.np.zeros(0, near.np.int64))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    marks = near.marked(df.selectExpr("doc_id AS key", "xxhash64(text) AS tag", "text"), 5, sh.simhash)
    node = {r.key: r.node for r in marks.collect()}
    pairs = near.close_pairs(marks.select("node", "fp"), sh.near_links).collect()
    assert {node[0], node[1]} in [{p.u, p.v} for p in pairs]
    assert {r.key for r in marks.collect() if any(r.node in (p.u, p.v) for p in pairs)} >= {0, 1, 4, 5, 6}


def counted(monkeypatch):
    """The tables that are written to the shared folder from now on, one entry each."""
    seen, real = [], common.checkpointed
    for module in (common, near, sh):
        monkeypatch.setattr(module, "checkpointed", lambda df: seen.append(df.columns) or real(df))
    return seen


def test_few_tables_are_written(spark, monkeypatch):
    """Both kinds of candidates are checked in one step, and components end with the step that leaves stars only."""
    rng, texts = random.Random(12), []
    for _ in range(20):
        words = [f"w{rng.random()}" for _ in range(60)]
        texts += [" ".join(words), " ".join(edited(rng, words, 1)), " ".join(rng.random().hex() for _ in range(20))]
    seen = counted(monkeypatch)
    got = sh.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(60) if i % 3 != 1] and len(seen) <= 10


def test_components_by_depth(spark, monkeypatch):
    seen = counted(monkeypatch)
    link = lambda pairs: {(r.node, r.root) for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert link([(1, 5), (6, 1), (1, 6), (-3, 8), (7, 7)]) == {(1, 1), (5, 1), (6, 1), (-3, -3), (8, -3)} and len(seen) == 1
    for n in (2, 3, 9, 40):
        names = random.Random(n).sample(range(-500, 500), n)
        assert link(list(itertools.pairwise(names))) == {(x, min(names)) for x in names}
    assert link([(i, j) for i in (1, 4, 9) for j in (4, 5, 30)]) == {(x, 1) for x in (1, 4, 5, 9, 30)}
