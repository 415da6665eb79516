"""The other operators against brute force, round trips or held-out accuracy, with nulls, ties, empty tables and clashing names."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import chat, jaccard, lines, lm, quality, tokenfile, toxicity, warc
from tarnwork.llm import queries as Q
from tarnwork.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# -- WARC --------------------------------------------------------------------------------------------


def pages(spark):
    rows = [(3, "http://a", "x"), (1, "http://b", "x"), (2, None, None), (5, "http://c\r\nX: y", ""), (None, "u", "x"), (9, "u", "é" * 5000), (9, "u", "é" * 5000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first")


def test_op3_edges(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(pages(spark), path)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, path).collect()), key=repr)
    want = [(3, "revisit", 1, 1), (1, "response", None, 1), (2, "response", None, 0), (5, "revisit", 2, 0), (None, "revisit", 1, 1), (9, "response", None, 10000), (9, "response", None, 10000)]
    assert got == sorted(want, key=repr)
    only = warc.read_archives(spark, path, split_bytes=100).where("record_type = 'response' and page_id > 1")
    assert sorted(r.page_id for r in only.select("page_id").collect()) == [2, 9, 9]
    assert "payload" not in warc.read_archives(spark, path, payload=False).columns
    assert {r.page_id: bytes(r.payload).decode() for r in only.collect()} == {2: "", 9: "é" * 5000}


def test_op3_ranges_cover_each_record_once(spark):
    df = spark.createDataFrame([(k, f"u{k}", "".join(map(chr, np.random.default_rng(k).integers(97, 123, k % 7 * 900)))) for k in range(200)], "page_id long, url string, html string").coalesce(2)
    path = scratch_path(spark, "warc")
    warc.write_archives(df, path, min_bytes=1)
    for split in (300, 5000, 1 << 20):
        got = warc.read_archives(spark, path, split_bytes=split).select("page_id", F.length("payload").alias("n"), "record_type").collect()
        assert sorted(r.page_id for r in got) == list(range(200)) and all(r.n == r.page_id % 7 * 900 for r in got if r.record_type == "response")


def test_op3_foreign_archive(spark, tmp_path):
    """Header names in any case, without a blank after the colon, folded; an HTTP response's payload; no index."""
    import gzip

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi</p>"
    one = b"WARC/1.0\r\nwarc-type:response\r\nWARC-Target-URI: http://a/\r\n  b\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-TYPE: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(two) + gzip.compress(one))
    (tmp_path / "b.warc").write_bytes(one + two)
    got = sorted((r.record_type, r.uri, bytes(r.payload)) for r in warc.read_archives(spark, f"file://{tmp_path}").collect())
    assert got == [("response", "http://a/ b", b"<p>hi</p>")] * 2 + [("warcinfo", None, b"abc")] * 2


def test_op3_pushdown_skips_payloads():
    from pyspark.sql.datasource import EqualTo, StringContains
    from pyspark.sql.types import StructType

    reader = warc.WarcReader({"path": "/tmp"}, StructType.fromDDL(warc.SCHEMA))
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), StringContains(("uri",), "x")]))
    assert len(reader.tests) == 1 and len(left) == 1


def test_op3_min_bytes_and_empty(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(pages(spark), path, min_bytes=2)
    assert warc.read_archives(spark, path).where("record_type = 'revisit'").count() == 0
    path = scratch_path(spark, "warc")
    warc.write_archives(pages(spark).limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_op3_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for r in rows:
        first[r.html] = min(first.get(r.html, r.page_id), r.page_id)
    want = {(r.page_id, len(r.html.encode()), base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode(), "response" if first[r.html] == r.page_id else "revisit", None if first[r.html] == r.page_id else first[r.html]) for r in rows}
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in Q.op3_warc(spark, SF).collect()} == want


# -- toxicity ------------------------------------------------------------------------------------------


def test_op4_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    links = toxicity.train(docs, labels.where("doc_id % 4 <> 0"), ["quality", "toxic"])
    got = toxicity.score(docs, links, ["a", "b"]).join(labels.where("doc_id % 4 = 0"), "doc_id").select("toxic", "b").collect()
    assert len(links[1].earlier) == 1
    assert sum(r.b >= 0.5 for r in got if r.toxic == 0) <= 1 and sum(r.b >= 0.5 for r in got if r.toxic) >= 0.3 * sum(r.toxic for r in got)


def test_op4_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "x " * 20000), (3, "y")], "doc_id long, text string").selectExpr("*", "1 as quality", "2 as _id", "3 as _text", "4 as _y0")
    labels = spark.createDataFrame([(1, 1, None), (3, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'t' as text")
    links = toxicity.train(docs, labels, ["quality", "toxic"])
    assert toxicity.score(docs, links, ["p_q", "p_t"]).where("p_t between 0 and 1").count() == 5
    assert toxicity.train(docs, labels.limit(0), ["toxic"]) == []
    assert toxicity.score(docs, [], ["p"]).where("p is null").count() == 5
    assert toxicity.score(docs.limit(0), links, ["p_q", "p_t"]).count() == 0


def test_op4_bounds_rows_and_not_ids_alone(spark):
    """One id with more texts than may train: as many as the bound train, the same at each run."""
    docs = spark.createDataFrame([(1, f"bad word{k} awful") for k in range(40)] + [(k, f"fine text number {k}") for k in range(2, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 12)], "doc_id long, toxic int")
    first, again = (toxicity.train(docs, labels, ["toxic"], max_labelled=20)[0] for _ in range(2))
    assert (first.chosen == again.chosen).all() and np.allclose(first.weights, again.weights)
    assert toxicity.train(docs, labels, ["toxic"], max_labelled=0) == []


# -- token files -----------------------------------------------------------------------------------------


def test_op5_file_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 300, 20000):
        for ids in (rng.integers(0, 50000, n), rng.zipf(1.3, n) % 40000, np.full(n, 7)):
            data = tokenfile.pack(ids.astype(np.uint32), [3, None], np.array([n // 2, n - n // 2]))
            docs, lengths, back = tokenfile.unpack(data)
            assert docs == [3, None] and lengths.sum() == n and (back == ids).all()
    assert (tokenfile.unpack(data, range(3, 5))[2] == 7).all()
    for at in (20, len(data) - 3):
        with pytest.raises(ValueError):
            tokenfile.unpack(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        tokenfile.pack(np.array([1 << 28]), [1], np.array([1]))


def test_op5_beats_static_order_0(spark):
    """Bits an id of a file, header and all, on prose: below the entropy of single ids."""
    from tarnwork.llm.bpe import encoder

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ends, ids = encoder(Q.tokenizer_path()).encode_arrays(tokenfile.pa.array(texts))
    data = tokenfile.pack(ids, list(range(len(texts))), np.diff(ends))
    n = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * len(data) / len(ids) < -(n * np.log2(n)).sum()
    assert (tokenfile.unpack(data)[2] == ids).all()


def test_op5_whole_table(spark, documents):
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(Q.tokenizer_path()), 0, set()
    for i, text in sorted(documents):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in Q.op5_token_files(spark, SF).collect()} == want


def test_op5_edges(spark):
    df = spark.createDataFrame([(5, "a b"), (None, None), (5, "a b"), (2, "")], "doc_id long, text string").selectExpr("*", "1 as id", "2 as key")
    path = scratch_path(spark, "tokens")
    tokenfile.write_token_files(df, path, Q.tokenizer_path())
    got = sorted((r.start, r.doc_id, len(r.ids)) for r in tokenfile.read_token_files(spark, path).collect())
    assert [(s, n) for s, _, n in got] == [(0, 1), (1, 1), (2, 3), (5, 3)] and [d for _, d, _ in got] == [None, 2, 5, 5]
    path = scratch_path(spark, "tokens")
    tokenfile.write_token_files(df.limit(0), path, Q.tokenizer_path())
    assert tokenfile.read_token_files(spark, path).count() == 0


def test_op5_many_files_in_order(spark, documents):
    """Files of a few texts each, and their order once numbers have more digits than names were padded to."""
    rows = sorted(documents)[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "tokens")
    files = tokenfile.write_token_files(df, path, Q.tokenizer_path(), file_chars=max(1, sum(len(t) for _, t in rows) // 25))
    assert len(files) > 10
    got = tokenfile.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids)
    assert tokenfile.in_order(["part-1000000.twt", "part-999999.twt", "part-000002.twt"]) == ["part-000002.twt", "part-999999.twt", "part-1000000.twt"]


# -- lines ---------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(docs, most=2, least=20):
    docs = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0))
    first = {}
    for _, text in docs:
        for x in (text or "").split("\n"):
            if len(x) >= least:
                first.setdefault(x, len(first))
    every = list(first)
    gone = {x for i, x in enumerate(every) if any(abs(len(x) - len(y)) <= most and edits(x, y) <= most for y in every[:i])}
    seen, out = set(), {}
    for i, text in docs:
        kept = []
        for x in (text or "").split("\n"):
            if len(x) >= least:
                if x in gone or x in seen:
                    continue
                seen.add(x)
            kept.append(x)
        out[i] = None if text is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("most", [1, 2, 3])
def test_op6_distance(spark, most):
    random.seed(most)
    rows = []
    for _ in range(600):
        a = [random.choice("abé🙂") for _ in range(random.randint(0, 14))]
        b = "".join(a)
        for _ in range(random.randint(0, 4)):
            k = random.randint(0, len(a))
            a[k : k + random.randint(0, 1)] = random.choice([[], ["a"], ["c"]])
        a, b = sorted(("".join(a), b), key=len, reverse=True)
        if len(a) - len(b) <= most:
            rows.append((a, b, edits(a, b) <= most))
    df = spark.createDataFrame(rows, "a string, b string, near boolean")
    assert df.where(lines.distance_within(F.col("a"), F.col("b"), most) != F.col("near")).count() == 0


def test_op6_brute(spark):
    random.seed(2)
    base = ["".join(random.choice("abcd ") for _ in range(random.randint(18, 40))) for _ in range(20)]
    docs = []
    for d in range(50):
        own = []
        for _ in range(random.randint(0, 5)):
            a = list(random.choice(base))
            for _ in range(random.choice([0, 0, 1, 2, 3, 5])):
                k = random.randrange(len(a))
                a[k : k + random.randint(0, 1)] = random.choice(["", "x", "yé"])
            own.append("".join(a))
        docs.append((d, "\n".join(own)))
    docs += [(None, docs[3][1]), (100, None), (101, ""), (102, "z" * 30000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "2 as line", "3 as key", "4 as _id", "5 as _key", "6 as _lost", "7 as _tk", "8 as g")
    out = lines.dedup_lines(df)
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(docs)
    assert set(df.columns) <= set(out.columns)
    assert lines.dedup_lines(df.limit(0)).count() == 0
    twice = lines.dedup_lines(df.where("doc_id = 7").unionByName(df.where("doc_id = 7")))
    assert twice.select("text").distinct().count() == 1 and twice.count() == 2


# -- language model ----------------------------------------------------------------------------------------------


def test_op7_base_and_held_out(spark, documents):
    train = Counter()
    for i, text in documents:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*(text or "").encode().lower().split(), "END"])
    n, v = sum(train.values()), len(train)
    got = {r.doc_id: r for r in Q.op7_lm(spark, SF).collect()}
    for i, text in documents:
        words = [*(text or "").encode().lower().split(), "END"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(words), sum(train[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op7_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (1000, 1 << 40), (1000, 1200), (5000, 1 << 63), (70_000, 1 << 41)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        if top == 1 << 41:  # a stretch that fills many words with ones, and a long one without any
            values = np.unique(np.concatenate([values[values < top // 4], np.arange(1 << 36, (1 << 36) + 60_000, dtype=np.uint64), np.array([top - 1], np.uint64)]))
        about, arrays = {}, {}
        lm.EliasFano.build(values, top, "x", about, arrays)
        coded = lm.EliasFano(about, arrays, "x")
        assert (coded.get(np.arange(len(values))) == values).all()
        here, after = coded.range(np.arange(len(values) - 1))
        assert (here.view(np.uint64) == values[:-1]).all() and (after.view(np.uint64) == values[1:]).all()
        place, found = coded.successor(values)
        assert found.all() and (place == np.arange(len(values))).all()
        other = rng.integers(0, top, 500, dtype=np.uint64)
        assert (coded.successor(other)[1] == np.isin(other, values)).all()
        inside = coded.successor(values, np.full(len(values), len(values) // 2), np.full(len(values), len(values)))[1]
        assert (inside == (np.arange(len(values)) >= len(values) // 2)).all()
    pointers = np.sort(rng.integers(0, 50, 3000, dtype=np.uint64))  # repeated values
    lm.EliasFano.build(pointers, 50, "p", about, arrays)
    assert (lm.EliasFano(about, arrays, "p").get(np.arange(3000)) == pointers).all()


def test_op7_edges(spark):
    docs = spark.createDataFrame([(1, "a b a b a b c a b c"), (2, "b c a"), (None, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 as score")
    model = lm.build(docs.select("text"))
    assert lm.score(docs, model).where("score < 0").count() == 4
    nothing = lm.build(docs.limit(0).select("text"))
    assert lm.score(docs, nothing).where("n_known = 0 and train_tokens = 0").count() == 4
    assert lm.score(docs.limit(0), model).count() == 0


# -- chat --------------------------------------------------------------------------------------------------------------


def test_op8_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|end|>", "[\\\\INST]", "", None, "a<|text|>b\n", "<<s>", "[[INST]"]
    rows = [(1, k, role, x) for k, (role, x) in enumerate((r, x) for x in odd for r in ("user", "assistant"))] + [(2, 0, "user", "q"), (None, 0, None, "<|"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as example", "2 as chars")
    out = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r, x or "") for x in odd for r in ("user", "assistant")]
    assert [x for x in out[1].loss] == [x or "" for x in odd]
    assert [t.text for t in out[3].turns] == ["s", "b", "b"] and list(out[3].loss) == ["b", "b"]
    assert [(t.role, t.text) for t in out[None].turns] == [("", "<|")] and "".join(out[None].loss) == ""
    examples = chat.expand(df.where("conv_id = 1")).collect()
    assert len(examples) == len(odd) and all(e.text[e.loss_start : e.loss_start + e.loss_chars] == e.text[: -len(chat.END)].rsplit(chat.TEXT, 1)[1] for e in examples)
    assert chat.expand(df.limit(0)).count() == 0


def test_op8_long_conversation(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"t{k}") for k in range(600)]
    got = chat.read_back(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in got.turns] == [r[3] for r in rows] and list(got.loss) == [r[3] for r in rows if r[2] == "assistant"]


# -- quality ---------------------------------------------------------------------------------------------------------------


def test_op9_counts_and_labels(spark, documents):
    got = {r.doc_id: r for r in Q.op9_quality(spark, SF).collect()}
    for i, text in documents:
        words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        three = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {j for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
        own = [x for x in (text or "").split("\n") if x.strip()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r.kept and r.base_failed)


def test_op9_fit_is_plain_em():
    """Accuracies and posteriors from pattern counts equal those of an EM that goes over the documents one by one."""
    rng = np.random.default_rng(4)
    good = rng.random(400) < 0.7
    votes = [tuple(int(rng.choice([-1, 0, 1], p=[0.1, 0.5, 0.4] if g else [0.4, 0.5, 0.1])) for _ in range(3)) for g in good]
    share, chances = quality.fit(list(Counter(votes).items()), rounds=30)
    prior, s = [[0.35, 0.40, 0.25], [0.01, 0.49, 0.50]], 0.01 * len(votes) + 1
    p, table = 0.7, [[list(prior[c]) for _ in range(3)] for c in (0, 1)]
    for _ in range(30):
        post = []
        for v in votes:
            like = [w * np.prod([table[c][r][x + 1] for r, x in enumerate(v)]) for c, w in ((0, 1 - p), (1, p))]
            post.append(like[1] / sum(like))
        weight = [[1 - x for x in post], post]
        table = [[[(sum(w for w, v in zip(weight[c], votes, strict=True) if v[r] == x) + s * prior[c][x + 1]) / (sum(weight[c]) + s) for x in (-1, 0, 1)] for r in range(3)] for c in (0, 1)]
        p = (sum(post) + 0.7 * s) / (len(votes) + s)
    assert share == pytest.approx(p, abs=1e-6) and np.allclose(chances, table, atol=1e-6)
    assert np.mean((quality.posterior(np.array(votes), share, chances) > 0.5) == good) > 0.75


def test_op9_kept_follows_the_posterior(spark):
    got = Q.op9_quality(spark, SF).collect()
    assert all(r.kept == (not r.base_failed and r.p_good >= 0.5) for r in got) and {r.kept for r in got} == {True, False}


def test_op9_against_labels(spark):
    got = Q.op9_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) > 0.97 * len(got)


def test_op9_edges(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "a\n" * 9000), (2, "a\n" * 9000)], "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as _pattern", "3 as p_good")
    assert "_pattern" in quality.judge(df).columns
    assert quality.judge(df).count() == 4
    assert quality.judge(df.limit(0)).count() == 0


# -- Jaccard join -----------------------------------------------------------------------------------------------------------


def brute_jaccard(docs):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for k, (d, _) in enumerate(docs):
        ids = [docs[m][0] for m in range(len(docs)) if group[m] == group[k] and docs[m][0] is not None]
        out.append((d, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=repr)


def test_op10_whole_table(spark, documents):
    assert sorted(map(tuple, Q.op10_jaccard(spark, SF).collect()), key=repr) == brute_jaccard(documents)


def test_op10_families(spark):
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(random.choices(vocabulary, k=random.randint(1, 80)))) for k in range(40)]
    base = random.choices(vocabulary, k=120)
    for k in range(60):
        copy = list(base)
        for _ in range(random.randint(0, 5)):
            copy[random.randrange(len(copy))] = random.choice(vocabulary)
        docs.append((100 + k, " ".join(copy)))
    docs += [(900, docs[0][1]), (901, docs[0][1].upper()), (None, docs[1][1]), (None, "alone here"), (902, None), (903, ""), (904, "Two"), (905, "two"), (7, docs[7][1]), (906, " ".join(base * 100))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as c", "3 as n")
    old = jaccard.ROUNDS, jaccard.BLOCK, jaccard.OFTEN, jaccard.KNOWN
    for jaccard.ROUNDS, jaccard.BLOCK, jaccard.OFTEN, jaccard.KNOWN in ((1, 24, 5, 3), old):
        assert sorted(map(tuple, jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_jaccard(docs)
    assert jaccard.join(df.limit(0)).count() == 0


def test_op10_any_id(spark):
    """Ids of the whole range of 64 bits, none at all, one id for several texts, and repeated rows of a component's first."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = [(2**63 - 1, a), (2**62, a + " x"), (2**62 + 1, b), (-5, b + " y"), (-(2**63), "alone in the world at last"), (None, a + " z"), (None, a + " z"), (3, b), (3, a), (3, b), (None, ""), (8, None)]
    got = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_jaccard(docs)
    assert sorted(((r.doc_id, r.n_shingles) for r in got if r["first"]), key=repr) == sorted([(-5, 57), (-(2**63), 2), (3, 56), (None, 0), (8, 0)], key=repr)


# -- pipeline ------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        path = scratch_path(spark, "test-stage")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before) and (name == P.STAGES[-1][0] or out.columns == docs.columns)
        if name == "line dedup":
            want = brute_lines(before.items())
            assert after == {i: x for i, x in want.items() if x == before[i] or "".join((x or "").split())}
        elif name == "n-gram Jaccard join":
            assert set(after) == {d for d, _, c in brute_jaccard(sorted(before.items())) if c == d}
        elif name != "toxicity":
            assert len(after) > 0.8 * len(before)
        docs = out
    assert docs.where("ids is null").count() == 0


def test_pipeline_edges(spark):
    """Nulls in any column, empty texts, repeated rows, an empty table, and extra columns of the names used inside."""
    import corpus_pipeline as P

    long = " ".join(f"word{k}" for k in range(80))
    rows = [(1, None, None), (2, "", "a"), (None, long, "b"), (None, long, "b"), (3, long + " more", "c"), (3, long + " more", "c"), (None, None, None), (4, "short", None), (5, "short", None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as _id", "2 as _row", "3 as _quality", "4 as _toxic", "5 as _n_lines", "6 as _key")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        got = stage(spark, docs, SF)
        assert set(docs.columns) <= set(got.columns) and (name == P.STAGES[-1][0] or got.columns == docs.columns)
        kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
        if name == "n-gram Jaccard join":
            assert kept == sorted([(1, None), (2, ""), (3, long + " more"), (None, None), (4, "short")], key=repr)
        else:  # the line of 3 is five edits from the earlier one
            assert kept == sorted([(i, t) for i, t, _ in rows], key=repr), name


def test_pipeline_decisions(spark):
    """The first, fourth and last stage against what their operators' own tests are held to."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    links = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ["quality", "toxic"])
    want = {r.doc_id for r in toxicity.score(docs, links, ["q", "t"]).where("t < 0.5").collect()}
    got = {r.doc_id for r in stages["toxicity"](spark, docs, SF).collect()}
    assert got == want and len(got) < docs.count()
    hit = {r.doc_id for r in Q.op1_decontaminate(spark, SF).where("n_hit > 0").collect()}
    got = {r.doc_id for r in stages["benchmark decontamination"](spark, docs, SF).collect()}
    assert hit and got == {r.doc_id for r in docs.select("doc_id").collect()} - hit
    tok = Tokenizer.from_file(Q.tokenizer_path())
    for r in stages["BPE encoding and decoding"](spark, docs, SF).limit(40).collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
