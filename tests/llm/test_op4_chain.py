"""The classifier chain against dense matrices: the same features, folds and choice of columns, fitted by Newton's method."""

import re
import zlib

import numpy as np
import pytest

from tarnwork.llm import toxicity

L2 = 0.01


def texts(n=160, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        good, toxic = rng.random() < 0.5, rng.random() < 0.35
        words = [f"w{j}ord" for j in rng.integers(0, 30, 12)]
        words += [f"good{j}ness" for j in rng.integers(0, 6, 3 if good else 1)] + [f"nasty{j}" for j in rng.integers(0, 6, 2 if toxic else 0)]
        if rng.random() < 0.2:
            words += ["nasty1", "good2ness"]
        rng.shuffle(words)
        out.append((i * 7, " ".join(words) if i % 40 else None, int(good), int(toxic)))
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def features(text):
    found = set()
    for word in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower().encode()):
        found.add(b"=" + word)
        found |= {word[:k] for k in range(4, 9) if len(word) > k}
    return {zlib.crc32(f) % 2**18 for f in found}


class Dense:
    """One category's model over all columns: those of a score above 2 that at least 3 texts have, the rest with weight 0."""

    def __init__(self, x, earlier, y):
        n, share = x.sum(0), y.mean()
        score = np.abs(x.T @ y - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9) + 1)
        self.columns = np.nonzero((n >= 3) & (score > 2))[0]
        a = np.column_stack([x[:, self.columns], earlier, np.ones(len(y))])
        penalty = np.zeros(a.shape[1])
        penalty[: len(self.columns)] = L2
        w = np.zeros(a.shape[1])
        for _ in range(100):
            p = sigmoid(a @ w)
            slope = a.T @ (p - y) / len(y) + penalty * w
            bend = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(penalty)
            step = np.linalg.solve(bend, slope)
            w -= step
            if np.abs(step).max() < 1e-12:
                break
        self.w = w

    def __call__(self, x, earlier):
        return sigmoid(np.column_stack([x[:, self.columns], earlier, np.ones(len(x))]) @ self.w)


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_dense_chain(spark, parts):
    data = texts()
    sets = [features(r[1]) for r in data]
    every = sorted(set().union(*sets))
    x = np.array([[b in s for b in every] for s in sets], float)
    ys = [np.array([r[k] for r in data], float) for k in (2, 3)]
    fold = np.array([zlib.crc32(str(r[0]).encode()) % 4 for r in data])
    first = Dense(x, np.zeros((len(data), 0)), ys[0])
    out = np.zeros(len(data))
    for k in range(4):
        out[fold == k] = Dense(x[fold != k], np.zeros(((fold != k).sum(), 0)), ys[0][fold != k])(x[fold == k], np.zeros(((fold == k).sum(), 0)))
    second = Dense(x, out[:, None], ys[1])
    use = first(x, np.zeros((len(data), 0)))
    want = np.column_stack([use, second(x, use[:, None])])

    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").repartition(parts)
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in data], "doc_id long, quality int, toxic int")
    links = toxicity.train(docs, labels, ["quality", "toxic"], l2=L2, steps=20_000)
    assert [set(link.chosen.tolist()) for link in links] == [{every[c] for c in m.columns} for m in (first, second)]
    assert abs(links[1].earlier[0] - second.w[-2]) < 0.01 and abs(second.w[-2]) > 0.05  # the chain is used
    got = {r.doc_id: (r.q, r.t) for r in toxicity.score(docs, links, ["q", "t"]).collect()}
    assert len(got) == len(data) and np.abs(np.array([got[r[0]] for r in data]) - want).max() < 1e-3
    none = toxicity.score(docs.where("text is null"), links, ["q", "t"]).first()
    assert abs(none.q - sigmoid(first.w[-1])) < 1e-3
