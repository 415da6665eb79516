"""Importance resampling towards a target distribution over hashed n-grams: documents whose features are commoner in the target than in the corpus are drawn.

External sort-count. A first pass writes each text's features as a stream of packed 16-bit bucket numbers, a chunk of documents to a row, with the places where
documents begin. Counts come from sorting each chunk's stream and the lengths of its runs; weights from gathering the buckets' gains along the
streams and `np.add.reduceat` from document to document. A feature's bucket is its CRC-32 modulo the number of buckets: the CRC of a run of words
follows from its words' by shifts of the register, which are table look-ups over whole chunks.

Defined results: a null text, or one without words, has no features and weight 0; it is never drawn with `least_words` of 1 or more. Texts of any length are
taken whole: long ones are cut into parts of `PART` bytes at ends of words, features across a cut included, so memory is bounded by the
text itself and a part's features. Rows of one id are documents of their own; of rows with one score the smaller id is drawn first, a null id last, and
rows alike in both are interchangeable. An empty corpus gives an empty table, an empty target only gains for what is rare. Other columns, whatever
their names, play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import as_bytes, discard, pieces, placed, written

#: Bytes of text of a chunk, and of a part of a longer text.
PART = 1 << 20
#: A-Z become a-z; digits, letters and all beyond ASCII are words; the rest is between words.
WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
TABLE = bytes(b if b in WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Lengths up to which shifting the register over a word has a table of its own.
TABLED = 64
STREAM = "part string, doc_id array<long>, n_words array<long>, n_features array<long>, stream binary"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The register after n zero bytes is the xor of four look-ups, one for each of its bytes: [n, byte, value] for n below TABLED, and for powers of 2."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1).astype(np.uint32)
    dense = np.empty((TABLED, 4, 256), np.uint32)
    dense[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, TABLED):
        dense[n] = step[dense[n - 1] & 255] ^ (dense[n - 1] >> 8)
    powers = np.empty((32, 4, 256), np.uint32)
    powers[0] = dense[1]
    for j in range(1, 32):
        powers[j] = _look(powers[j - 1].ravel(), 0, powers[j - 1])
    return dense, powers


def _look(table: np.ndarray, base: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    out = table[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= table[base + (256 * k + ((crc >> np.uint32(8 * k)) & 255))]
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs as they are after n more bytes, but for what these bytes add: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    dense, powers = _tables()
    out = _look(dense.ravel(), np.minimum(n, TABLED - 1) * 1024, crc)
    if n.max(initial=0) >= TABLED:
        far = np.flatnonzero(n >= TABLED)
        some, left = crc[far], n[far]
        for j in range(32):
            on = (left >> j) & 1 == 1
            some[on] = _look(powers[j].ravel(), 0, some[on])
        out[far] = some
    return out


def buckets(words: list[bytes], ends: np.ndarray, n_buckets: int, runs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(stream, features of each document): of each word in turn, the buckets of the runs of 1 to `runs` words that begin with it. `ends`: words up to each document's end."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint16), np.zeros(len(ends), np.int64)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    size = np.fromiter(map(len, words), np.int64, n)
    begins = np.concatenate([[0], ends[:-1]])
    left = np.repeat(ends, ends - begins) - np.arange(n)  # words to the document's end, with this one
    blank = np.uint32(zlib.crc32(b" "))
    out, there = np.empty((n, runs), np.uint16), np.empty((n, runs), bool)
    run = crc
    for k in range(runs):
        if k:  # `run` is of the k words from here on; one word more
            spaced = shifted(run, np.ones(1, np.int64)) ^ blank
            run = shifted(spaced[:-1], size[k:]) ^ crc[k:]
        out[: n - k, k], there[:, k] = run % np.uint32(n_buckets), left > k
    made = np.minimum(left, runs)
    total = np.concatenate([[0], np.cumsum(made)])
    return out[there], total[ends] - total[begins]


def parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PART bytes, cut where a word ends."""
    at = 0
    while len(text) - at > PART:
        cut = BETWEEN.search(text, at + PART)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _streams(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def row(part: str | None, ids: list, n_words: list, stream: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, ids, n_words, n.tolist(), stream.tobytes()), kinds, strict=True)], names=["part", "doc_id", "n_words", "n_features", "stream"])

    for batch in pieces(batches, "text", PART):
        ids, words, n_words = [], [], []
        for doc_id, text, name in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("_row").to_pylist(), strict=True):
            if text is not None and len(text) > PART:
                yield from (row(name, [doc_id], [k], stream, n) for k, stream, n in _long(text, n_buckets))
                continue
            own = (text or b"").translate(TABLE).split()
            ids.append(doc_id)
            n_words.append(len(own))
            words += own
        if ids:
            yield row(None, ids, n_words, *buckets(words, np.cumsum(n_words), n_buckets))


def _long(text: bytes, n_buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, stream, features) of each part. The last two words of a part begin the next one, where their longer runs are found."""
    runs, kept = 3, []
    for piece in parts(text):
        new = piece.translate(TABLE).split()
        words = kept + new
        stream, n = buckets(words, np.array([len(words)]), n_buckets)
        # Features that lie in the words kept from the part before were counted there.
        old, _ = buckets(kept, np.array([len(kept)]), n_buckets)
        if len(old):
            counts = np.bincount(stream, minlength=n_buckets) - np.bincount(old, minlength=n_buckets)
            stream = np.repeat(np.arange(n_buckets, dtype=np.uint16), counts)
        yield len(new), stream, np.array([len(stream)])
        kept = words[-(runs - 1) :]


def streams(docs: DataFrame, n_buckets: int, doc_id: str | None = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of documents with their packed streams, written to the shared folder."""
    if not 0 < n_buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    rows = docs.select((F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")).alias("doc_id"), F.col(text).alias("text"), F.uuid().alias("_row"))
    # A row is large: groups of a few rows bound what a writer or reader holds, and no dictionary of streams helps.
    return written(rows.mapInArrow(lambda b: _streams(b, n_buckets), STREAM), "bucket-streams", **{"parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"})


def counts(chunks: DataFrame, n_buckets: int) -> np.ndarray:
    """How often each bucket is in the streams. The driver gets a number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for stream in batch.column("stream"):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), np.uint16), kind="stable")
                first = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[first]] += np.diff(first, append=len(ordered))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in chunks.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of a bucket's share in the target over that in the source, one feature added to each bucket, rounded down."""
    n = len(source)
    s_all, t_all = float(source.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source, target, strict=True)], np.int64)


def weights(chunks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n = np.asarray(batch.column("n_features")[row].values, np.int64)
                of = gain[np.frombuffer(batch.column("stream")[row].as_buffer(), np.uint16)]
                weight, some = np.zeros(len(n), np.int64), n > 0
                if some.any():
                    weight[some] = np.add.reduceat(of, (np.cumsum(n) - n)[some])
                part = batch.column("part").slice(row, 1).take(pa.array(np.zeros(len(n), np.int64)))
                yield pa.RecordBatch.from_arrays([part, batch.column("doc_id")[row].values, batch.column("n_words")[row].values, pa.array(n), pa.array(weight)], names=["part", "doc_id", "n_words", "n_features", "weight"])

    found = chunks.mapInArrow(gather, "part string, doc_id long, n_words long, n_features long, weight long")
    whole, cut = found.where("part is null").drop("part"), found.where("part is not null")
    return whole.unionByName(cut.groupBy("part", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight"))).drop("part"))


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's (doc_id, n_words, n_features, weight, score, rank): of those with `least_words` words, `percent` in a hundred are drawn without
    replacement in proportion to their weights, by the highest sums of weight and Gumbel noise; rank is 1, 2, 3... in that order, null if not drawn.
    """
    aims = streams(target, n_buckets, None, text)
    chunks = streams(docs, n_buckets, doc_id, text)
    found = weights(chunks, gains(counts(chunks, n_buckets), counts(aims, n_buckets)))
    discard(aims)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = found.withColumn("score", F.col("weight") + noise).withColumn("_some", F.when(F.col("n_words") >= least_words, "0").otherwise("1"))
    scored = written(scored, "weights")
    discard(chunks)
    rows = placed(scored, "_some", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "_place")
    discard(scored)
    drawn = rows.where("_some = '0'").count() * percent // 100
    rank = F.when((F.col("_some") == "0") & (F.col("_place") < drawn), F.col("_place") + 1)
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
