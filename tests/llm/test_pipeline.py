"""The five stages one after the other, and each on odd input."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from pathloom.llm import mixing, pii, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        body, toxic = text(rng.randint(5, 80)), rng.random() < 0.15
        docs.append((i, f"{body} Zonk! vilest {text(3)}" if toxic else body, "en", rng.choice(["a", "a", "a", "b", None]), 0))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic)))
    long = text(300)
    docs += [(300 + i, long, "en", "a", 0) for i in range(5)]  # exact copies
    docs += [(310 + i, long.replace(long.split()[50 * i + 9], f"edit{i}", 1), "de", "b", 0) for i in range(4)]  # near copies
    docs += [(400, f"write to me@site.org {text(30)}", "en", "b", 0), (401, None, None, None, None), (402, "", "en", "a", 0), (403, " \n", "en", "a", 0), (None, text(20), "en", "a", 0), (7, text(25), "en", "b", 0)]
    return docs, labels


@pytest.fixture()
def folder(spark, tmp_path):
    docs, labels = made()
    spark.createDataFrame(docs, KIND).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_each_stage_by_itself(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in cp.STAGES:
        before = docs.collect()
        after = spark.createDataFrame(stage(spark, docs, folder).collect() or [], stage(spark, docs, folder).schema)
        got = after.collect()
        if name != "byte_level_bpe":
            assert after.columns == names
        if name == "toxicity":
            model = toxicity.learnt(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            keep = sorted(str(tuple(r)[:5]) for r in toxicity.scored(docs, model).where("score < 0.3").collect())
            assert sorted(str(tuple(r)) for r in got) == keep and sum("Zonk" in (r.text or "") for r in got) < 6 < 200 < len(got)
        elif name == "near_duplicates":
            assert [r.doc_id for r in got if 300 <= (r.doc_id or 0) < 400] == [300]
            assert {r.text for r in got if (r.doc_id or 0) not in range(300, 400)} | {None, "", " \n"} == {r.text for r in before if (r.doc_id or 0) not in range(300, 400)} | {None, "", " \n"}
        elif name == "personal_data":
            spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
            assert {r.doc_id: r.text for r in got}[400].startswith("write to [EMAIL] ") and len(got) == len(before)
            assert {str(tuple(r)) for r in before if not spans[r.doc_id]} <= {str(tuple(r)) for r in got}
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mixed(docs).collect() if r.doc_id not in (None, 7)}
            times = Counter(r.doc_id for r in got)
            assert all(times[i] == n for i, n in copies.items()) and {r.text for r in got} <= {r.text for r in before}
        else:
            assert len(got) == len(before)
            texts = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in before}
            assert {r.decoded_sha256 for r in got} == texts
        docs = after


def test_run_gives_the_last_stage(spark, folder):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = cp.run(spark, folder).collect()
    assert rows and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(rows[0].asDict())
    plain = [r for r in rows if r.doc_id is not None and r.doc_id != 7 and hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() == r.decoded_sha256]
    assert len(plain) > 0.8 * len(rows)
    for r in plain:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_stages_on_empty_tables_and_extra_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    empty = spark.createDataFrame([], KIND)
    odd = spark.createDataFrame([(1, "a b c d e f", "x", "s", 3, "k", 1, 2.0), (1, "a b c d e f", "x", "s", 3, "k", 1, 2.0), (1, "other words are here now", "x", None, 3, None, None, None), (None, None, None, None, None, None, None, None)], KIND + ", spans string, key int, score double")
    for name, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        got = stage(spark, odd, str(tmp_path))
        rows = got.collect()
        if name != "byte_level_bpe":
            assert got.columns == odd.columns
        assert len(rows) == {"near_duplicates": 3}.get(name, 4) or name == "mixing"
