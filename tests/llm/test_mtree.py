import random

import numpy as np

from pathloom.llm import mtree as mt


def made():
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], "x") for i in range(900)]
    rows += [(i, [0.5] * 8, "x") for i in range(900, 1300)]
    rows += [(2000, None, "x"), (2050, [0.1, None] + [0.0] * 6, "x"), (2100, [float("nan")] + [0.0] * 7, "x"), (2150, [float("inf")] + [0.0] * 7, "x"), (2200, [1.0, 2.0], "x"), (2201, [0.5, 0.5], "x"), (2250, [], "x")]
    return [*rows, rows[0]]


def slow(rows, k=5):
    v = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % 50 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string").repartition(3)
    for page, block in ((1_024, 4_096), (40, 7)):
        monkeypatch.setattr(mt, "BLOCK", block)
        got = mt.top_k(df, df.where("vec_id % 50 = 0"), page=page).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == slow(rows)
    assert mt.top_k(df.limit(0), df.limit(0)).count() == 0
    assert mt.top_k(df, df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.25, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = mt.top_k(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(50, 1, 1, 32768), (50, 2, 2, 32768), (50, 3, 1, 16384), (50, 4, 2, 16384)]
    import duckdb

    t = df.toPandas()
    sql = duckdb.sql(mt.OP8_SQL.replace("FROM embeddings", "FROM t")).fetchall()
    assert len(t) == 6 and sorted(sql) == [(50, 1, 1, 32768), (50, 2, 2, 32768), (50, 3, 1, 16384), (50, 4, 2, 16384)]


def test_parent_distances_save_products():
    rng = np.random.default_rng(1)
    points = np.column_stack([rng.integers(-300, 300, 4000), rng.integers(-3, 4, (4000, 5))])
    tree = mt.Tree(float((points**2).sum(axis=1).max()), {6: points[:1]})
    near = tree.to_pivots(6, points, True)[:, 0]
    q = points[7:8]
    scores = (points @ q[0])[np.arange(4000) != 7]
    fifth = np.sort(scores)[-5]
    found, took = mt.page_answers(np.arange(4000), near, points, np.array([7]), tree.to_pivots(6, q, False)[:, 0], tree.reach(q, np.array([float(fifth)])), q, 5)
    assert np.concatenate(found)[:, 2].tolist() == np.sort(scores)[::-1][:5].tolist() and took < 4000
