"""Benchmark decontamination: a prefix-filtered set join.

A benchmark item's windows (runs of `window` words; a shorter item is one window) are sets of shingles. As a window must be
contained whole, one of its shingles is a necessary prefix: the rarest in the corpus, by document frequency. Documents
give only the shingles that can be in a prefix (a fixed-size bitmap of prefix hashes decides), with the words around
them; a join on the shingle finds the windows. Positions bound a candidate (the window must start at or after the document's first word
and end at or before its last), and the words themselves are compared, so results are exact.

Nothing that grows with the documents or the benchmark is broadcast by hand: only the bitmap, of a fixed size, leaves
the cluster; joins are Spark's to plan. Rows of a document never meet in one task beyond that document's own hits.

Defined results: null and empty texts have no words and no hits; rows are told apart by id and text, so repeated rows
each get the same result; a null id is an id of its own; items without words match nothing; a null item id marks
words as hit but is not listed; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.llm.common import as_bytes, crcs, discard, shingles, slices, text_key, written

#: Bits of the bitmap that tells which shingles are of use; full or not, results are the same.
BITS = 1 << 25
#: Words: what is left when ASCII control characters, space and punctuation are cut out; A-Z count as a-z.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _sizes(window: int, shingle: int) -> list[int]:
    return list(range(1, min(window, shingle) + 1))


def _hashes(found: list[bytes], sizes: list[int]) -> dict[int, np.ndarray]:
    base = crcs(found)
    return {k: shingles(base, k) for k in sizes}


def _windows(items: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """(item_id as string, words): distinct windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, texts = [], []
            for i, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                found = words(text)
                if found:
                    own = {b" ".join(found[k : k + window]).decode() for k in range(max(1, len(found) - window + 1))}
                    ids += [i] * len(own)
                    texts += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item_id", "words"])

    return items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("t")).mapInArrow(run, "item_id string, words string").distinct()


def _tokens(texts: DataFrame, shingle: int) -> DataFrame:
    """(words, n, at, size, hash): the shingles of distinct windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in as_bytes(part.column(0)):
                found = text.split(b" ")
                size = min(shingle, len(found))
                rows += [(text.decode(), len(found), at, size, h) for at, h in enumerate(_hashes(found, [size])[size].view(np.int64).tolist())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["words", "n", "at", "size", "hash"])

    return texts.mapInArrow(run, "words string, n int, at int, size int, hash long")


def _bitmap(tokens: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of BITS bits of the hashes, and the sizes of shingles there are. Both are of bounded size."""
    bit = F.shiftrightunsigned("hash", 64 - int(BITS).bit_length() + 1) + 1
    rows = tokens.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for k, m in rows:
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)
    return out, sorted(r[0] for r in tokens.select("size").distinct().collect())


def _of_use(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(64 - int(BITS).bit_length() + 1)
    return np.flatnonzero(bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)


def _frequencies(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """(hash, documents): in how many documents each shingle is that the bitmap lets through; summed within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [np.zeros(0, np.uint64)]
            for text in as_bytes(part.column(0)):
                for h in _hashes(words(text), sizes).values():
                    own.append(np.unique(h[_of_use(bitmap, h)]))
            h, n = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["hash", "documents"])

    return docs.select("text").mapInArrow(run, "hash long, documents long").groupBy("hash").agg(F.sum("documents").alias("documents"))


_CANDIDATES = "array<struct<hash: long, pos: int, start: int, words: string>>"


def _candidates(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """(doc_id, key, n_words, candidates): possible prefix shingles of each document, each with the words around it."""
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("start", pa.int32()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, found = [], []
            for text in as_bytes(part.column(2)):
                own = words(text)
                counts.append(len(own))
                rows = []
                for h in _hashes(own, sizes).values():
                    for p in _of_use(bitmap, h).tolist():
                        start = max(0, p - window + 1)
                        rows.append({"hash": int(h[p].view(np.int64)), "pos": p, "start": start, "words": b" ".join(own[start : p + window]).decode()})
                found.append(rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "key", "n_words", "candidates"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("key", T.LongType())])
    return docs.select("doc_id", "key", "text").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", n_words long, candidates {_CANDIDATES}")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5) -> DataFrame:
    """(doc_id, key, n_words, n_hit, item_ids, spans) for each row of `docs`.

    n_hit counts the words inside any occurrence of a window; item_ids are the items with such windows, as strings in
    order; spans are (start, n) in words, those that overlap or touch being one. key is `text_key` of the text.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    windows = written(_windows(items, item_id, item_text, window), "windows")
    tokens = written(_tokens(windows.select("words").distinct(), shingle), "tokens")
    often = _frequencies(docs, *_bitmap(tokens))
    rarest = F.min_by(F.struct("n", "at", "hash"), F.struct(F.coalesce("documents", F.lit(0)), "hash", "at"))
    prefixes = written(tokens.join(often, "hash", "left").groupBy("words").agg(rarest.alias("p")).select("words", "p.*"), "prefixes")
    bitmap, _ = _bitmap(prefixes.withColumn("size", F.least("n", F.lit(shingle))))
    found = written(_candidates(docs, bitmap, sorted(r[0] for r in prefixes.select(F.least("n", F.lit(shingle))).distinct().collect()), window), "candidates")

    start = F.col("c.pos") - F.col("at")
    here = F.slice(F.split("c.words", " "), F.greatest(start - F.col("c.start") + 1, F.lit(1)), F.col("n"))
    hits = (
        found.select("doc_id", "key", "n_words", F.explode("candidates").alias("c"))
        .join(prefixes.withColumnRenamed("words", "window_words"), F.col("c.hash") == F.col("hash"))
        .where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .where((start >= F.col("c.start")) & (F.array_join(here, " ") == F.col("window_words")))
        .select("doc_id", "key", start.alias("start"), "n", "window_words")
        .distinct()
    )
    hits = written(hits, "hits")
    discard(tokens, prefixes)
    # Overlapping windows are one span, so that a wholly contaminated text has one span and not one for each of its words.
    by = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    ends = hits.select("doc_id", "key", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    ends = ends.withColumn("reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("no", F.sum((F.coalesce("reach", F.lit(-1)) < F.col("start")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = ends.groupBy("doc_id", "key", "no").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n"))
    spans = whole.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("spans"))
    named = (
        hits.select("doc_id", "key", "window_words").distinct().join(windows, F.col("window_words") == F.col("words"))
        .groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    both = spans.join(named, same(spans, named), "left").select(spans["doc_id"], spans["key"], "spans", "item_ids")
    rows = found.select("doc_id", "key", "n_words")
    covered = F.aggregate("spans", F.lit(0), lambda total, s: total + s["n"])
    return rows.join(both, same(rows, both), "left").select(
        rows["doc_id"], rows["key"], "n_words",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<start: int, n: int>>")).alias("spans"),
    )
