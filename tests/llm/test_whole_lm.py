"""The language model keeps n-grams and words that occur once: its scores against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tarnwork.llm import lm
from tarnwork.llm import queries as Q

SF = "/root/testdata/sf0.001"


class Brute:
    def __init__(self, train):
        marked = [["<", *(t or "").encode().lower().split(), ">"] for t in train]
        self.n = {k: Counter(tuple(m[i : i + k]) for m in marked for i in range(len(m) - k + 1)) for k in (1, 2, 3)}
        self.tokens, self.distinct = sum(n for w, n in self.n[1].items() if w != ("<",)), len(self.n[1]) - bool(train)
        self.next = {k: Counter(g[:-1] for g in self.n[k]) for k in (2, 3)}

    def p(self, words):
        if len(words) == 1:
            return (self.n[1][words] + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))
        total = self.n[len(words) - 1][words[:-1]]
        if not total or words[:-1][-1] == ">":
            return self.p(words[1:])
        return max(self.n[len(words)][words] - lm.D, 0) / total + lm.D * self.next[len(words)][words[:-1]] / total * self.p(words[1:])

    def score(self, text):
        m = ["<", *(text or "").encode().lower().split(), ">"]
        return sum(np.log10(self.p(tuple(m[max(0, i - 2) : i + 1]))) for i in range(1, len(m)))


TRAIN = ["one two three four five six seven eight", "nine ten three eleven five", "twelve thirteen", "one two three", " Two\tthree\x0bfour \n", None, "", "the the the a the b the c the the a"]
TEXTS = [*TRAIN, "two three four unseen five six", "nine ten three four", "six one", "the c the z", "new words only", "the"]


@pytest.mark.parametrize("shard_tokens", [4_000_000, 3, 8])  # one shard; many shards, and most or some first words dealt out by the second
def test_op7_keeps_what_occurs_once(spark, shard_tokens):
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    model = lm.build(train, shard_tokens=shard_tokens)
    assert (model.shards > 1) == (shard_tokens < 10) and (len(model.hot) > 0) == (shard_tokens < 10)
    got = lm.score(spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string"), model).orderBy("k").collect()
    brute = Brute(TRAIN)
    for r, text in zip(got, TEXTS, strict=True):
        assert abs(r.score - brute.score(text)) <= 0.001 * r.n_tokens  # probabilities and weights are quantised
        assert r.n_tokens == len((text or "").split()) + 1


def test_op7_sums_to_one(spark):
    model = lm.build(spark.createDataFrame([(t,) for t in TRAIN], "text string"), shard_tokens=5)
    trie = lm.Trie(model)
    words = sorted({w for t in TRAIN for w in (t or "").lower().split()})
    for context in (["one", "two"], ["the", "the"], ["the", "b"], ["nine", "unseen"], ["unseen", "three"], ["three"], []):
        total = 0.0
        for w in [*words, "another", None]:
            seq = ["<", *context, *([w] if w else []), ">"]
            hashes = np.array([lm.START, lm.END, *(lm.xxhash.xxh3_64_intdigest(x.encode()) for x in seq[1:-1])], np.uint64)
            places = np.array([0, *range(2, len(seq)), 1]) if len(seq) > 2 else np.array([0, 1])
            at = len(context) + 1  # the word, or the end
            total += 10 ** trie.score(places, np.array([0]), trie.look_up(hashes))[at]
        assert total == pytest.approx(1, abs=0.003), context


def test_op7_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    brute = Brute([t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1])
    got = {r.doc_id: r for r in Q.op7_lm(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        assert abs(got[i].score - brute.score(text)) <= 0.001 * got[i].n_tokens


def test_op7_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 50)
    monkeypatch.setattr(lm, "RANKS", 3)  # more words than ranks: the n-grams of a slice are not summed before they are sent
    texts = [" ".join(f"w{k * k % 97}" for k in range(n)) for n in (3000, 5, 0, 40)]
    pieces = list(lm.pieces(iter([lm.pa.RecordBatch.from_arrays([lm.pa.array(texts)], names=["text"])]), "text", 50))
    assert [p.num_rows for p in pieces] == [1, 2, 1]
    model = lm.build(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r, text in zip(lm.score(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), model).orderBy("k").collect(), texts, strict=True):
        assert abs(r.score - Brute(texts).score(text)) <= 0.001 * r.n_tokens
