import json
import random
import unicodedata

import public_tokenizers
import regex

from pathloom.llm import wordpiece as wp


def greedy(word, pieces):
    symbols, n, at = [*word, wp.END], 0, 0
    while at < len(symbols):
        end = next((e for e in range(len(symbols), at, -1) if "".join(symbols[at:e]) in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_is_the_greedy_longest_match():
    rng = random.Random(13)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + rng.choice(["", wp.END]) for _ in range(rng.randint(1, 25))}
        if rng.random() < 0.5:
            pieces |= {x + e for x in "abc" for e in ("", wp.END)}
        a = wp.Automaton(pieces)
        for _ in range(60):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert a.count(w) == greedy(w, pieces), (w, pieces)


def test_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path) as f:
        spec = json.load(f)
    pieces = set(spec["model"]["vocab"])
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    texts = [None, "", " \n", "It's the Quick brown-fox, 123!", "schönes Öl 漢字 🙂", "antidisestablishmentarianism " * 50, "q" * 3000, "x " * 600_000]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wp.token_counts(docs).collect()}
    table = wp._alphabet()
    for i, t in enumerate(texts[:-1]):
        words = [m.group() for w in (t or "").split() for m in regex.finditer(split, w.lower())]
        assert got[i] == (len((t or "").split()), sum(greedy("".join(table[b] for b in w.encode()), pieces) for w in words))
    assert got[len(texts) - 1] == (600_000, 600_000)
    assert wp.token_counts(docs.limit(0)).count() == 0


def test_decomposed_text_counts_as_composed(spark):
    texts = ["schönes Öl, café crème À BIENTÔT", "naïve Zoë naïve", "한국어 漢字"]
    docs = spark.createDataFrame([(i, unicodedata.normalize(form, t)) for i, t in enumerate(texts) for form in ("NFC", "NFD")], "doc_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_tokens) for r in wp.token_counts(docs).collect()}
    assert len(got) == len(texts)
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        assert "NFC" in json.dumps(json.load(f)["normalizer"])
