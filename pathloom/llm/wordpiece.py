"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary's strings make a trie. Matching a word goes down the trie; where it can't, the failure link of the node names
the node that holds what is left after the longest pieces have been taken off, and the node's popped count says how many
pieces that were. So one pass over a word gives its number of pieces, and no piece is ever built. Words end with a mark of
their own, which pieces at the end of a word include.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import table, text_batches

END = "</w>"
REMEMBER = 60_000


class Automaton:
    """Trie with failure links over symbols; the mark of a word's end is one symbol.

    A word that can't be cut into pieces of the vocabulary counts as one piece, the unknown.
    """

    def __init__(self, pieces):
        self.next: list[dict[str, int]] = [{}]
        whole = [False]
        for p in pieces:
            v = 0
            for c in (*p[: -len(END)], END) if p.endswith(END) and p != END else p:
                w = self.next[v].get(c)
                if w is None:
                    w = self.next[v][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                v = w
            whole[v] = True
        # fail is -1 where nothing can be taken off; popped is what following the link takes off.
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        level = [(0, c, v) for c, v in self.next[0].items()]
        while level:
            deeper = []
            for u, c, v in level:
                if whole[v]:
                    self.fail[v], self.popped[v] = 0, 1
                elif u:
                    z, n_popped = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n_popped += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], n_popped
                deeper += [(v, d, w) for d, w in self.next[v].items()]
            level = deeper

    def count(self, word: str) -> int:
        """The number of greedy longest-match pieces of a word and its end mark."""
        next_, fail, popped = self.next, self.fail, self.popped
        v = n = 0
        for c in (*word, END):
            w = next_[v].get(c)
            while w is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return 1
                w = next_[v].get(c)
            v = w
        while v:
            n += popped[v]
            v = fail[v]
            if v < 0:
                return 1
        return n


@functools.lru_cache(maxsize=1)
def _alphabet() -> dict[int, str]:
    """The printable stand-ins for bytes that byte-level vocabularies use: bytes that print are themselves, others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[Automaton, str]:
    with open(path) as f:
        spec = json.load(f)
    special = {x["content"] for x in spec["added_tokens"]}
    split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    return Automaton(p for p in spec["model"]["vocab"] if p not in special), split


def counter(path: str, remember: int = REMEMBER):
    """A function that counts a text's pieces, remembering words."""
    automaton, split = _vocabulary(path)
    pattern, table_, known = regex.compile(split), _alphabet(), {}

    def part(s: str) -> int:
        return sum(automaton.count("".join(map(table_.__getitem__, m.group().encode()))) for m in pattern.finditer(s))

    def count(text: str) -> int:
        # The vocabulary's reading: composed (NFC), lower case. Words never span white space, and neither step looks beyond one.
        total = 0
        for w in text.split():
            n = known.get(w)
            if n is None:
                n = part(unicodedata.normalize("NFC", w).lower())
                if len(known) > remember:
                    known.clear()
                if len(w) <= 40:
                    known[w] = n
            total += n
        return total

    return count


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, n_words, n_tokens): white-space words and greedy word pieces of every whole text.

    Null and empty texts have none, and very long ones are counted whole. Each row counts by itself, so repeated rows agree; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        count = counter(path)
        for b in batches:
            words, tokens = [], []
            for x in b.column(1):
                t = x.as_py() or ""
                at = n = w = 0
                while at < len(t):
                    end = min(len(t), at + (1 << 20))
                    while end < len(t) and not t[end].isspace():
                        end += 1
                    n, w, at = n + count(t[at:end]), w + len(t[at:end].split()), end
                words.append(w)
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["key", "n_words", "n_tokens"])

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, n_words long, n_tokens long").withColumnRenamed("key", key)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and word pieces."""
    return token_counts(table(spark, sf_dir, "documents"))
