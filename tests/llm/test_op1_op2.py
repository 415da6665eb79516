"""Decontamination and BPE against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tarnwork.llm import queries as Q
from tarnwork.llm.bpe import TreeEncoder, decode, encode
from tarnwork.llm.decontaminate import decontaminate

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=10):
    windows = {}
    for i, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def rows(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in df.collect()], key=repr)


def test_op1_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    got = Q.op1_decontaminate(spark, SF).collect()
    assert sum(w[2] > 0 for w in want) > 0
    want = {(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in want}
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want


def test_op1_edges(spark):
    random.seed(3)
    vocabulary = ["a", "b", "É", "x9"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(0, 14)))) for i in range(30)] + [(None, "a b É x9 a b"), (7, None), (8, " ,.!"), (3, "b b b b"), (3, "b b b b")]
    docs = [(i, " ".join(random.choices(vocabulary, k=random.choice([0, 1, 5, 40, 3000])))) for i in range(20)] + [(None, "A b, é x9 a b!"), (5, None), (5, None), (6, ""), (4, "a a"), (4, "a a")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as words", "1 as n", "2 as item_id", "3 as hash")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    assert rows(decontaminate(d, b)) == brute(docs, items)
    assert rows(decontaminate(d.limit(0), b)) == []
    assert rows(decontaminate(d, b.limit(0))) == brute(docs, [])


def reference(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    return [(e := tok.encode(x or "", add_special_tokens=False).ids, tok.decode(e, skip_special_tokens=False)) for x in texts]


def test_op2_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for r, (i, d) in zip(docs, reference([r.text for r in docs]), strict=True)}
    assert {tuple(r) for r in Q.op2_bpe(spark, SF).collect()} == want


@pytest.mark.parametrize("leaf", [8, 32, 4096])
def test_op2_edges(spark, leaf):
    random.seed(leaf)
    letters = "abcdeABC'sdtmrell019!!?<|>endoftext é́ñßΣİ中文あがゞ한가̧́ \n\t\x85　\x1c🙂"
    texts = ["".join(random.choices(letters, k=random.randint(0, 300))) for _ in range(150)]
    texts += [None, "", " ", "x" * 5000, "ab" * 3000, "中文" * 900, "a<|endoftext|>b " * 200, "!!'re" * 500, "it's " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").selectExpr("*", "1 as ids", "n as decoded")
    path = Q.tokenizer_path()
    got = {r.n: (list(r.ids), r.decoded) for r in decode(encode(df, path, leaf=leaf), path).collect()}
    assert [got[k] for k in range(len(texts))] == reference(texts)
    assert decode(encode(df.limit(0), path), path).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None)], "n long, text string")
    assert [list(r.ids) for r in encode(nulls, path).collect()] == [[], []]


def test_op2_tree_of_tokens():
    random.seed(0)
    tree = TreeEncoder(Q.tokenizer_path(), leaf=16, window=2)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    for _ in range(300):
        text = "".join(random.choices("abcehilnorst" + random.choice(["", "'", "1", "!é中", " "]), k=random.randint(1, 600)))
        assert [t[0] for t in tree.tokens(text)] == tok.encode(text, add_special_tokens=False).ids
