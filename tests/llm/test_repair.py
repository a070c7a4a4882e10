import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pathloom.llm import repair as rp


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip_and_random_access(seed, monkeypatch):
    monkeypatch.setattr(rp, "FLAT", 1 << 22 if seed % 2 else 0)
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, 50, rng.integers(1, 7)) for _ in range(30)]
    docs = [np.concatenate([words[i] for i in rng.integers(0, 30, rng.integers(0, 60))] or [np.zeros(0, int)] + [[0]]) for _ in range(40)]
    docs += [np.zeros(301, int), np.zeros(1, int), np.arange(50)]
    ids = np.concatenate(docs).astype("<u4")
    block = rp.Block(rp.pack(list(range(len(docs))), [len(d) for d in docs], ids, 60))
    assert len(block.seq) < 0.8 * len(ids) and len(block.rules)
    assert np.array_equal(rp.expand(block.rules, block.seq, 60), ids) and block.ends[-1] == len(ids)
    for about in (1, 100, 1 << 18):
        assert all(k == i and np.array_equal(x, docs[i]) for i, (k, x) in enumerate(block.documents(about)))
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert np.array_equal(block.ids(a, b), ids[a:b])


def test_files_hold_all_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rp, "BLOCK_TOKENS", 500)
    rng = random.Random(12)
    parts = ["the ", "It's", "\n\n", "  ", "é", "漢字 ", "🙂", " 123", " x", "<|endoftext|>", " < |endoftext|>"]
    rows = [(7 * i - 50, "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 60, 900])))) for i in range(80)]
    rows += [(9999, None), (10_000, ""), (10_001, "same"), (10_001, "same")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, range int").repartition(5)
    rp.write_ids(docs, str(tmp_path / "ids"))
    got = sorted((r.start, r.key, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rp.read_ids(spark, str(tmp_path / "ids")).collect())
    t, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for k, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((start, k, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert sorted((r.start, r.key, r.n_tokens, r.ids_crc32) for r in rp.read_checksums(spark, str(tmp_path / "ids")).collect()) == want


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    rp.write_ids(docs, str(tmp_path / "none"))
    assert rp.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_files_ascend(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rp, "parts_for_bytes", lambda *a: 4)
    docs = spark.range(500).selectExpr("(id * 37) % 500 as doc_id", "repeat(concat('w', id, ' '), 20) as text").repartition(7)
    rp.write_ids(docs, str(tmp_path / "ids"))
    keys = []
    for f in sorted((tmp_path / "ids").glob("part-*.parquet")):
        for b in sorted(spark.read.parquet(str(f)).collect(), key=lambda r: r.block):
            keys.append([k for k, _ in rp.Block(bytes(b.data)).documents()])
    assert len(keys) > 2 and [k for x in keys for k in x] == list(range(500))


def test_names_that_the_files_use_themselves(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 5), i, i, "x", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file int, block int, tag string, key int")
    got = []
    for df, name in ((docs, "a"), (docs.select("doc_id", "text"), "b")):
        rp.write_ids(df, str(tmp_path / name))
        got.append(sorted(tuple(r) for r in rp.read_checksums(spark, str(tmp_path / name)).collect()))
    assert got[0] == got[1] and len(got[0]) == 40
