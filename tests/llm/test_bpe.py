import base64
import hashlib
import random
import struct

import public_tokenizers
import tiktoken

from pathloom.llm import bpe


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    parts = ["the", "It's", " we'll", "  ", "\n", " \n ", "\t", "é", "漢字", "🙂", "123", "!!", "'", " ' ", " ", " x", "\x1f", "\x0b", "a b", " ", "<|endoftext|>"]
    made = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 5, 60, 400]))) for _ in range(60)]
    return [None, "", " ", "\n", *made, "a" * 3000, " " * 3000 + "x", "é" * 3000, "word " * 2000, "x\n\n" * 900]


def test_chunks_stitch_to_the_whole(spark):
    enc, rows = encoding(), list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in [*rows, rows[7]]], "doc_id long, text string, ids string, row int").repartition(3)
    for chunk, overlap in ((64, 16), (1000, 100), (bpe.CHUNK, bpe.OVERLAP)):
        got = [(r.doc_id, bytes(r.ids)) for r in bpe.encode(docs, chunk=chunk, overlap=overlap).collect()]
        want = [(i, b"".join(struct.pack("<I", x) for x in enc.encode_ordinary(t or ""))) for i, t in [*rows, rows[7]]]
        assert sorted(got) == sorted(want)


def test_digests(spark):
    enc, rows = encoding(), list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode(docs)).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.digests(bpe.encode(docs.limit(0))).count() == 0
