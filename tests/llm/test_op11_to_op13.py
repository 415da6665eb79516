"""Top-k search, importance resampling and Merkle manifest against brute force, with nulls, ties, repeated rows, long texts, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import dualtree, importance, merkle
from tarnwork.llm import queries as Q

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- top-k -------------------------------------------------------------------------------------------


def brute_top(rows, k, scale, every):
    """Sorted (query_id, rank, vec_id, score)."""
    width = max((len(v) for _, v in rows if v is not None), default=0)
    fine = [(i, [math.floor(scale * x) for x in v] + [0] * (width - len(v))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if i is not None and i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, d, strict=True)), math.inf if j is None else j) for b, (j, d) in enumerate(fine) if a != b)
            out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def got_top(df):
    return sorted([(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()], key=repr)


def test_op11_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got_top(Q.op11_topk(spark, SF)) == brute_top(rows, 10, 1024, 100)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, row int, cell int, score int")


def test_op11_edges(spark, monkeypatch):
    """Nulls, non-finite components, ties, repeated rows and ids, other lengths; small blocks and groups, so that trees, cells and salts have several parts."""
    for name, n in (("BLOCK", 16), ("GROUP", 4), ("LEAF", 4), ("SAMPLE", 40), ("ABREAST", 2)):
        monkeypatch.setattr(dualtree, name, n)
    rng = np.random.default_rng(5)
    at = rng.normal(size=(4, 3))
    rows = [(k, [float(np.float32(x)) for x in np.round(at[k % 4] * (1 + k % 3) + rng.normal(size=3) / 4, 1)]) for k in range(150)]
    rows += [(300 + k, [0.5, 0.5, 0.5]) for k in range(60)]  # one common vector
    rows += [(10, [0.5, 0.5, 0.5]), (10, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5]), (None, None), (500, None), (510, [1.0, None, 1.0]), (520, [float("nan"), 0.0, 0.0]), (530, [float("inf"), 0.0, 0.0]), (540, [2.0]), (550, [])]
    for k in (1, 7, 300):
        assert got_top(dualtree.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, k, 16)) == brute_top(rows, k, 16, 10)
    assert got_top(dualtree.top_k(vectors(spark, rows[:1]), F.col("vec_id") % 10 == 0)) == []
    assert got_top(dualtree.top_k(vectors(spark, []), F.col("vec_id") % 10 == 0)) == []
    assert got_top(dualtree.top_k(vectors(spark, rows[1:9]), F.col("vec_id") % 10 == 0)) == []


def test_op11_trees():
    """A node's points lie within its radius of its centre, which is a point of its own; children's centres are apart by what they cover; large numbers are exact."""
    rng = np.random.default_rng(1)
    x = rng.integers(-99, 99, (500, 4))
    tree = dualtree.build(np.arange(500), np.arange(500), x)
    assert sorted(tree.rows) == list(range(500)) and (tree.points == x[tree.rows]).all()
    for k, (b, e, c, first, n) in enumerate(tree.nodes):
        assert b <= c < e and np.isclose(np.sqrt(((tree.points[b:e] - tree.points[c]) ** 2).sum(1)).max(), tree.radius[k])
        if n:
            own = tree.nodes[first : first + n]
            assert (own[0, 0], own[-1, 1]) == (b, e) and c in own[:, 2]
            apart = [np.linalg.norm(tree.points[i] - tree.points[j]) for i in own[:, 2] for j in own[:, 2] if i < j]
            assert min(apart) >= tree.radius[first : first + n].max() - 1e-9
    big = np.array([[3 << 40, 1], [5, -7]])
    assert dualtree.exact_products(big, big >> 22).tolist() == [[sum(int(a) * (int(b) >> 22) for a, b in zip(p, q, strict=True)) for q in big] for p in big]
    with pytest.raises(OverflowError):
        dualtree.exact_products(big, big)


def test_op11_prunes():
    """Clusters far apart: most pairs of leaves are never compared."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-20, 20, (256, 4)) + 4000 * np.eye(4, dtype=int)[k % 4] for k in range(4)])
    tree = dualtree.build(np.arange(1024), np.arange(1024), x)
    seen = []
    real, dualtree.exact_products = dualtree.exact_products, lambda a, b: seen.append(len(a) * len(b)) or real(a, b)
    try:
        best = dualtree.search(tree, tree, 5)
    finally:
        dualtree.exact_products = real
    scores = tree.points @ tree.points.T
    np.fill_diagonal(scores, -(1 << 60))
    assert (np.sort(best.score, 1) == np.sort(scores, 1)[:, -5:]).all() and sum(seen) < 1024 * 1024 / 2


# -- importance resampling -----------------------------------------------------------------------------


def brute_resample(docs, target, n_buckets=10_000, least=20, percent=5, seed=42):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % n_buckets for k in (1, 2, 3) for i in range(len(words) - k + 1))

    own, aims = [(i, *features(t)) for i, t in docs], [features(t)[1] for t in target]
    s, t = sum((f for _, _, f in own), Counter()), sum(aims, Counter())
    s_all, t_all = float(s.total()), float(t.total())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + n_buckets) / ((s[b] + 1) * (t_all + n_buckets)))) for b in s}
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        out.append([i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    some = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(some[: percent * len(some) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got_resample(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_op12_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got_resample(Q.op12_resample(spark, SF)) == brute_resample(docs, target)


def test_op12_edges(spark, monkeypatch):
    """Null and empty texts, ids that are null or repeated, ties, a word longer than a part, texts of many parts, all of them small."""
    rng = random.Random(3)
    words = ["a", "Bc", "É", "d1", "x" * 70, "漢字", "y" * 300]
    docs = [(k % 90, " ,.\n"[k % 4].join(rng.choices(words, k=rng.randrange(0, 60)))) for k in range(120)]
    docs += [(None, "b c " * 30)] * 3 + [(7, "b c " * 30)] * 2 + [(8, None), (9, ""), (None, None), (91, "-" * 5000), (92, "z" * 5000), (93, " ".join(rng.choices(words, k=5000)))]
    target = ["a b c d", None, "", "É d1 " * 50]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, score int, rank int, part string")
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    for part in (64, 1 << 20):
        monkeypatch.setattr(importance, "PART", part)
        assert got_resample(importance.resample(df, aims, 50, 20, 30)) == brute_resample(docs, target, 50, 20, 30)
    assert got_resample(importance.resample(df, aims.limit(0), 50, 1, 100)) == brute_resample(docs, [], 50, 1, 100)
    assert got_resample(importance.resample(df.limit(0), aims)) == []


def test_op12_buckets():
    """Runs' buckets come from the words' checksums as from the runs' own bytes, for short, long and very long words."""
    rng = random.Random(4)
    words = [bytes(rng.choices(range(97, 123), k=rng.choice([1, 2, 9, 63, 64, 65, 700, 70_000]))) for _ in range(60)]
    ends = np.array([0, 2, 2, 3, 60])
    stream, n = importance.buckets(words, ends, 997)
    runs = [b" ".join(words[i : i + k]) for b, e in zip([0, *ends], ends, strict=False) for i in range(b, e) for k in (1, 2, 3) if i + k <= e]
    assert stream.tolist() == [zlib.crc32(r) % 997 for r in runs] and n.sum() == len(runs) and n[2] == 0


# -- Merkle manifest -----------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fan=8):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows of (doc_id, text, lang, source, n_chars)."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(i, text, lang, source, n):
        return digest(*map(field, (i, source, lang, n, text)))

    def tree(leaves):
        """(root, paths): a path is (before, after) at each level."""
        paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
        while len(level) > 1:
            for k, a in enumerate(at):
                run = level[a // fan * fan : a // fan * fan + fan]
                paths[k].append((run[: a % fan], run[a % fan + 1 :]))
            level = [digest(*level[b : b + fan]) for b in range(0, len(level), fan)]
            at = [a // fan for a in at]
        return level[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for x in langs}
    trees = {x: tree([leaf(*r) for r in of[x]]) for x in langs}
    if not langs:
        return []
    root, tops = tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for r, path in zip(of[x], trees[x][1], strict=True):
            own = leaf(r[0], r[1] if r[1] is None else r[1].translate(LOWER), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(*r)
            for before, after in path + top:
                own = digest(*before, own, *after)
            proof = digest(*(h for before, after in path + top for h in before + after))
            out.append((r[0], leaf(*r), trees[x][0], root, proof, own, own == root))
    return sorted(out, key=repr)


def got_manifest(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def test_op13_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert got_manifest(Q.op13_manifest(spark, SF)) == brute_manifest(rows)


def test_op13_edges(spark, tmp_path):
    """Nulls in every column, groups of 1, 8, 9, 65 and many names, repeated rows, long texts, clashing columns, no rows."""
    rows = [(k, f"Text {k}" * (k % 5), lang, None if k % 7 == 0 else "s", k) for lang, n in (("en", 65), (None, 9), ("-", 1), ("", 8), ("é", 2), ("z", 1)) for k in range(n)]
    rows += [(None, None, None, None, None), (3, None, "en", "s", None), (3, "X", "en", "s", 1), (3, "X", "en", "s", 1), (4, "AÉ" * 200_000, "en", "s", 1)] + [(1, "t", f"g{k}", "s", 1) for k in range(20)]
    for name, some in (("all", rows), ("one", rows[:1]), ("lang", rows[:65]), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(*r, "x", 1) for r in some], "doc_id long, text string, lang string, source string, n_chars long, leaf string, _no int").write.parquet(f"file://{folder}/documents.parquet")
        assert got_manifest(Q.op13_manifest(spark, f"file://{folder}")) == brute_manifest(some)


def test_op13_other_fan(spark):
    rows = [(k, "t", "en", "s", k) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for fan in (2, 3, 100):
        found = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], fan=fan)
        roots = {r.root for r in found.select("root", merkle.fold(F.col("leaf"), F.col("path")).alias("folded")).where("folded = root").collect()}
        assert roots == {brute_manifest(rows, fan)[0][3]} and found.count() == 20
