import itertools
import random
import re
from collections import Counter

from pathloom.llm import audit


def fails(text, key, keys_of):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else ""
    out += "D" if set(text) & set("#$%&*|") else ""
    return out + ("E" if key is not None and any(k is not None and k < key for k in keys_of[text]) else "")


def slow(docs, labels):
    keys_of = {}
    for key, text, *_ in docs:
        keys_of.setdefault(text or "", []).append(key)
    rows = [(lang or "", fails(text or "", key, keys_of), labels.get(key, (0, 0))) for key, text, lang, *_ in docs]
    out = Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, failed, (quality, toxic) in rows:
            gone = False
            for step, f in enumerate(order, 1):
                hit = f in failed
                out[part, order, step, "kept"] += not gone and not hit
                out[part, order, step, "removed"] += hit and not gone
                out[part, order, step, "redundant"] += hit and gone
                out[part, order, step, "unique_fails"] += failed == f
                out[part, order, step, "good_lost"] += hit and not gone and quality == 1
                out[part, order, step, "toxic_lost"] += hit and not gone and toxic == 1
                out[part, f, "shapley"] += hit and not gone
                gone |= hit
    return out


def made(rng):
    docs = []
    for i in range(250):
        words = rng.choices(["ab", "Ab", "é", "CAPS", "x$", "日本"] + [f"w{j}" for j in range(300)], k=rng.choice([0, 5, 99, 100, 101, 160]))
        text = rng.choice([" ", "\n", "\t "]).join(words)
        docs.append((i, rng.choice([text, text, text, "", None, "same text"]), rng.choice(["en", "en", "de", "", None]), "x", 1))
    docs += [(300 + i, docs[7][1], "en", "x", 1) for i in range(5)]
    return [*docs, *docs[:20], (None, docs[7][1], "en", "x", 1), (None, None, None, "x", 1), (400, "long " * 70_000 + "end", "en", "x", 1)]


def test_every_order_against_plain_loops(spark):
    docs = made(random.Random(3))
    labels = {i: (i % 3 == 0, i % 5 == 0) for i in range(0, 320, 2)}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, words string, key int").repartition(5)
    marks = spark.createDataFrame([(k, int(q), int(t)) for k, (q, t) in labels.items()] + [(4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels[4] = (1, labels[4][1])
    want = slow(docs, labels)
    got = audit.steps(audit.set_counts(audit.flagged(df), marks)).collect()
    parts = {lang or "" for _, _, lang, *_ in docs}
    assert len(got) == len(parts) * 120 * 5 == len({(r.part, r.filter_order, r.step) for r in got})
    for r in got:
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[c] == want[r.part, r.filter_order, r.step, c], (r, c)
        assert r.shapley == want[r.part, r.filter_order[r.step - 1], "shapley"]


def test_words_of_long_texts_are_not_cut(spark):
    words = ["y" * 70_000, *(f"a{i % 20_000}" for i in range(40_000))]
    df = spark.createDataFrame([(1, 5, "\x0b ".join(words))], "key long, tag long, body string")
    assert [tuple(r) for r in audit.word_counts(df).select("words", "kinds").collect()] == [(40_001, 20_001)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.steps(audit.set_counts(audit.flagged(docs), labels)).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], docs.schema)
    got = audit.steps(audit.set_counts(audit.flagged(one), labels)).collect()
    assert len(got) == 600 and sum(r.removed for r in got) == 120 and sum(r.good_lost for r in got) == 0
