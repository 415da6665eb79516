"""Toxicity by classifier chains: linear models that predict categories one after another.

Features are the distinct words of a text and their beginnings, hashed into buckets. The model of each category sees
the buckets that tell its classes apart, and the probabilities of the categories before it; those are out-of-fold
predictions in training, so that a later model meets them as it will in use. Training takes a bounded sample of labelled rows
(`max_labelled` at most, of the ids of the smallest hash), in one task; scoring is a narrow pass over all whole texts.

Defined results: null and empty texts have no features and get the chances that the bias alone gives; rows without an id or with a null
label do not train; of several labels of an id the largest holds; an id that several texts share trains on each, within the bound;
texts are taken whole at any length, a very long one has more features only;
a category with one class only has its share as a constant; without any labelled row all probabilities are null.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.llm.common import as_bytes, slices
from tarnwork.llm.decontaminate import words

BUCKETS = 1 << 18
#: Lengths in bytes of the beginnings that count besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
FOLDS = 4


def buckets(word: bytes) -> list[int]:
    return [zlib.crc32(b"=" + word) % BUCKETS, *(zlib.crc32(word[:k]) % BUCKETS for k in BEGINNINGS if len(word) > k)]


def _of_text(text: bytes | None) -> np.ndarray:
    found: set[int] = set()
    for word in set(words(text)):
        found.update(buckets(word))
    return np.array(sorted(found), np.int32)


@dataclass
class Link:
    """One category's model: chosen buckets, their weights, weights of earlier categories' probabilities, bias."""

    chosen: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _choose(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Buckets whose documents differ most from the rest in their share of positives (score test)."""
    n, share = np.bincount(cols, minlength=BUCKETS).astype(float), y.mean()
    positive = np.bincount(cols, y[rows], minlength=BUCKETS)
    z = np.abs(positive - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9) + 1)
    z[n < 3] = 0
    return np.sort(np.argsort(-z, kind="stable")[:most][z[np.argsort(-z, kind="stable")[:most]] > 2])


def _fit(rows: np.ndarray, cols: np.ndarray, earlier: np.ndarray, y: np.ndarray, most: int, l2: float, steps: int) -> Link:
    """Logistic regression with an L2 penalty, by accelerated gradient steps."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    if y.min() == y.max():
        return Link(np.zeros(0, int), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
    chosen = _choose(rows, cols, y, most)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    c = place[cols]
    keep = c >= 0
    r, c = rows[keep].astype(np.intp), c[keep].astype(np.intp)  # as counting takes them, so that steps convert nothing
    m = len(chosen)
    w, v = np.zeros(m + earlier.shape[1] + 1), np.zeros(m + earlier.shape[1] + 1)
    w[-1] = v[-1] = np.log(share / (1 - share))

    def value(w: np.ndarray) -> np.ndarray:
        return np.bincount(r, w[:m][c], minlength=n) + earlier @ w[m:-1] + w[-1]

    x = np.ones(m + earlier.shape[1] + 1)  # the largest eigenvalue of X'X / 4n by power iteration
    size = 1.0
    for _ in range(12):
        z = value(x)
        x = np.concatenate([np.bincount(c, z[r], minlength=m), earlier.T @ z, [z.sum()]]) / (4 * n)
        size = np.linalg.norm(x)
        x /= size
    rate, t = 1 / (1.1 * size + l2), 1.0
    for _ in range(steps):
        error = (_sigmoid(value(v)) - y) / n
        slope = np.concatenate([np.bincount(c, error[r], minlength=m) + l2 * v[:m], earlier.T @ error, [error.sum()]])
        new = v - rate * slope
        again = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if slope @ (new - w) > 0:  # the momentum points uphill
            again = 1.0
        v, w, t = new + (t - 1) / again * (new - w), new, again
    return Link(chosen, w[:m], w[m:-1], float(w[-1]))


def _predict(link: Link, rows: np.ndarray, cols: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    weights = np.zeros(BUCKETS)
    weights[link.chosen] = link.weights
    return _sigmoid(np.bincount(rows, weights[cols], minlength=len(earlier)) + earlier @ link.earlier + link.bias)


def _chain(x: list[np.ndarray], ids: list, ys: list[np.ndarray], most: int, l2: float, steps: int) -> list[Link]:
    """The models of all categories, each trained with out-of-fold probabilities of those before it."""
    n = len(x)
    rows, cols = np.repeat(np.arange(n, dtype=np.int32), [len(a) for a in x]), np.concatenate(x)
    x.clear()
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids])
    links, earlier = [], np.zeros((n, 0))
    for done, y in enumerate(ys, 1):
        links.append(_fit(rows, cols, earlier, y, most, l2, steps))
        if done == len(ys):
            break
        out = np.full(n, y.mean())
        for k in range(FOLDS):
            if (fold == k).any() and (fold != k).any():
                at = np.cumsum(fold != k, dtype=np.int32) - 1
                inside = fold[rows] != k
                link = _fit(at[rows[inside]], cols[inside], earlier[fold != k], y[fold != k], most, l2, steps)
                out[fold == k] = _predict(link, rows, cols, earlier)[fold == k]
        earlier = np.column_stack([earlier, out])
    return links


def train(docs: DataFrame, labels: DataFrame, categories: list[str], *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 8192, most: int = 4096, l2: float = 3e-4, steps: int = 250) -> list[Link]:
    """The chain's models, one for each of `categories` (0/1 columns of `labels`), in that order. Only weights reach the driver."""
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(*(F.max(F.col(c).cast("int")).alias(f"_y{k}") for k, c in enumerate(categories)))
    known = known.where(F.col("_id").isNotNull()).dropna()
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)  # bounded, so it may be broadcast
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    ys = [f"_y{k}" for k in range(len(categories))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [_of_text(x).tobytes() for x in as_bytes(part.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_id", *ys)), pa.array(found, pa.binary())], names=["_id", *ys, "_x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got)
            x = [np.frombuffer(b, np.int32) for b in table.column("_x").to_pylist()]
            links = _chain(x, table.column("_id").to_pylist(), [table.column(y).to_numpy().astype(float) for y in ys], most, l2, steps)
            columns = [pa.array([pickle.dumps(link)], pa.binary()) for link in links]
            yield pa.RecordBatch.from_arrays(columns, names=ys)

    schema = T.StructType([joined.schema["_id"], *(T.StructField(y, T.IntegerType()) for y in ys), T.StructField("_x", T.BinaryType())])
    # The sample's ids may have more texts than max_labelled: the rows are bounded too, before one task gets them.
    rows = joined.mapInArrow(features, schema).orderBy(F.xxhash64("_id", "_x"), "_id", "_x").limit(max_labelled)
    found = rows.coalesce(1).mapInArrow(fit, ", ".join(f"{y} binary" for y in ys)).collect()
    return [pickle.loads(x) for x in found[0]] if found else []  # noqa: S301  written by the task above


def score(df: DataFrame, links: list[Link], names: list[str], text_col: str = "text") -> DataFrame:
    """`df` with a probability column for each category."""
    rest = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(n, T.DoubleType()) for n in names)])
    if not links:
        return df.select(*rest, *(F.lit(None).cast("double").alias(n) for n in names))
    union = np.unique(np.concatenate([link.chosen for link in links]))
    weights = np.zeros((len(links), len(union)))
    for k, link in enumerate(links):
        weights[k, np.searchsorted(union, link.chosen)] = link.weights
    chain = [(link.earlier, link.bias) for link in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {b: k for k, b in enumerate(union.tolist())}
        known: dict[bytes, tuple[int, ...]] = {}
        for part in slices(batches):
            out = np.zeros((part.num_rows, len(links)))
            for row, text in enumerate(as_bytes(part.column(text_col))):
                hit: set[int] = set()
                for word in set(words(text)):
                    own = known.get(word)
                    if own is None:
                        own = known[word] = tuple(place[b] for b in buckets(word) if b in place)
                    if own:
                        hit.update(own)
                z = weights[:, sorted(hit)].sum(1)
                for k, (earlier, bias) in enumerate(chain):
                    out[row, k] = _sigmoid(z[k] + out[row, :k] @ earlier + bias)
            if len(known) > 500_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(out[:, k]) for k in range(len(names)))], names=[*rest, *names])

    return df.select(*rest).mapInArrow(run, schema)
