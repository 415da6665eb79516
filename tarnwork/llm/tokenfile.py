"""Token-id files: adaptive context mixing and a range coder, in blocks that are reset and checksummed each.

Within a block, tables remember which id followed the last one (order 1) and the last two (order 2), with a confidence.
Three adaptive estimates of "the order-2 prediction holds", one from its own confidence, one from both orders' and one from the predicted id's
order-0 share, are mixed with adaptive weights; another gives order 1's chance if order 2 fails. One range-coding step says which
prediction holds. If none does, the id is coded by order 0: an adaptive choice of a bucket of ids (counts of the block so far,
renewed every RENEW ids), then the id within its bucket by the file's own counts, which are in its header.

All blocks of a file are coded side by side, one id of each at a time, so that each step is a few array operations; a
block needs only the header to be decoded. The coder is carry-less with 64-bit ranges and 32-bit output words.

Layout (little-endian): magic, length and CRC-32 of the header, header (zlib: JSON line, then packed arrays: ids with counts, document
ids, null marks, lengths), directory (words and CRC-32 of the payload and of the ids of each block), payloads.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.llm.bpe import SLICE, encoder
from tarnwork.llm.common import pieces, text_key

MAGIC = b"TWTOKEN1"
#: Blocks have at most this many ids, and fewer in files that would have few blocks.
BLOCK, LEAST_BLOCK, LANES = 4096, 2048, 2048
HASH1, HASH2 = 11, 12
BUCKETS, RENEW = 64, 32
MAX_ID = 1 << 27

_U = np.uint64
_MASK32 = _U(0xFFFFFFFF)
_SMALL = _U(1 << 32)


class _Order0:
    """The ids a file has: counts, and buckets of about equal shares, in the order of ids."""

    def __init__(self, used: np.ndarray, counts: np.ndarray) -> None:
        self.used, self.counts = used, counts
        self.ends = np.cumsum(counts.astype(np.int64))
        total = int(self.ends[-1]) if len(used) else 1
        self.bucket = np.minimum((self.ends - counts) * BUCKETS // total, BUCKETS - 1).astype(np.int64)
        self.starts = (self.ends - counts).astype(np.uint64)
        first = np.searchsorted(self.bucket, np.arange(BUCKETS))
        last = np.searchsorted(self.bucket, np.arange(BUCKETS), side="right")
        below = np.concatenate([[0], self.ends])
        self.base, self.size = below[first].astype(np.uint64), (below[last] - below[first]).astype(np.uint64)
        self.prior = np.maximum(self.size * _U(BUCKETS * 4) // _U(total), 1).astype(np.int64) * (self.size > 0)
        self.place = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
        self.place[used] = np.arange(len(used))
        #: How rare an id is, in eight classes.
        self.rarity = np.full(len(self.place), 7, np.int64)
        self.rarity[used] = np.clip(np.log2(total / np.maximum(counts, 1)).astype(np.int64) - 6, 0, 7)

    @classmethod
    def of(cls, ids: np.ndarray) -> _Order0:
        used, counts = np.unique(ids, return_counts=True)
        scale = max(1, int(counts.sum()) >> 21)  # sums stay below 2 ** 22, so that a step keeps its precision
        return cls(used.astype(np.uint32), np.maximum(counts // scale, 1).astype(np.uint32))


class _Model:
    """The state of all lanes: what was seen, how far it is trusted, and the range coder's range."""

    def __init__(self, lanes: int, order0: _Order0) -> None:
        self.n, self.order0 = lanes, order0
        self.t1, self.t2 = np.zeros(lanes << HASH1, np.uint32), np.zeros(lanes << HASH2, np.uint32)
        self.base1, self.base2 = np.arange(lanes) << HASH1, np.arange(lanes) << HASH2
        self.own, self.both, self.one = np.full(lanes * 16, 20000, np.int32), np.full(lanes * 512, 20000, np.int32), np.full(lanes * 32, 20000, np.int32)
        self.lane = np.arange(lanes)
        self.weight, self.weight0 = np.full(lanes, 128, np.int32), np.full(lanes, 192, np.int32)
        self.zero = np.full(lanes * 8, 20000, np.int32)
        self.p1, self.p2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.seen = np.tile(order0.prior, (lanes, 1))
        self.cum = np.zeros((lanes, BUCKETS + 1), np.uint64)
        self.renew()

    def renew(self) -> None:
        np.cumsum(self.seen, axis=1, out=self.cum[:, 1:].view(np.int64))

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The interval ends on 2 ** 16 of "order 2 holds" and "order 2 or 1 holds"."""
        self.i1 = self.base1 + ((self.p1 * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH1))
        self.i2 = self.base2 + (((self.p1 * np.uint32(0x85EBCA6B)) ^ (self.p2 * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - HASH2))
        e1, e2 = self.t1[self.i1], self.t2[self.i2]
        self.c1, self.c2 = e1 & np.uint32(15), e2 & np.uint32(15)
        self.g1, self.g2 = e1 >> np.uint32(4), e2 >> np.uint32(4)
        self.agree = self.g1 == self.g2
        self.k_own = self.lane * 16 + self.c2
        self.k_both = self.lane * 512 + (self.c2 * 32 + self.c1 * 2 + self.agree)
        self.k_one = self.lane * 32 + (self.c1 * 2 + (self.c2 > 2))
        self.a, self.b = self.own[self.k_own], self.both[self.k_both]
        self.k_zero = self.lane * 8 + self.order0.rarity[self.g2]
        self.z = self.zero[self.k_zero]
        self.ab = (self.weight * self.a + (256 - self.weight) * self.b) >> 8
        mixed = (self.weight0 * self.ab + (256 - self.weight0) * self.z) >> 8
        two = np.clip(mixed, 32, 65536 - 96)
        two[self.c2 == 0] = 1
        self.d = self.one[self.k_one]
        one = ((65536 - two) * self.d.astype(np.int64)) >> 16
        one = np.clip(one, 16, 65536 - two - 32)
        one[self.agree | (self.c1 == 0)] = 0
        return two.astype(np.uint64), (two + one).astype(np.uint64)

    def learn(self, ids: np.ndarray) -> None:
        hit2, hit1 = self.g2 == ids, self.g1 == ids
        target = hit2.astype(np.int32) << 16
        closer = np.abs(target - self.a) < np.abs(target - self.b)
        self.weight += np.where(closer, (255 - self.weight) >> 4, -(self.weight >> 4))
        closer = np.abs(target - self.ab) < np.abs(target - self.z)
        self.weight0 += np.where(closer, (255 - self.weight0) >> 4, -(self.weight0 >> 4))
        self.zero[self.k_zero] = self.z + ((target - self.z) >> 5)
        self.own[self.k_own] = self.a + ((target - self.a) >> 5)
        self.both[self.k_both] = self.b + ((target - self.b) >> 4)
        self.one[self.k_one] = np.where(hit2, self.d, self.d + (((hit1.astype(np.int32) << 16) - self.d) >> 5))
        for table, at, guess, sure, hit in ((self.t1, self.i1, self.g1, self.c1, hit1), (self.t2, self.i2, self.g2, self.c2, hit2)):
            less = sure >> np.uint32(1)
            fresh = ~hit & (less == 0)
            sure = np.where(hit, np.minimum(sure + np.uint32(1), np.uint32(15)), np.where(fresh, np.uint32(1), less))
            table[at] = (np.where(fresh, ids, guess) << np.uint32(4)) | sure
        self.p2, self.p1 = self.p1, ids


def _narrow(low: np.ndarray, range_: np.ndarray, begin: np.ndarray, size: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return low + begin * unit, size * unit


def _shift(low: np.ndarray, range_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lanes whose range is small: (low, range) moved on by 32 bits, the range cut where it straddles a boundary."""
    straddles = ((low ^ (low + range_ - _U(1))) >> _U(32)) != 0
    range_ = np.where(straddles, _SMALL - (low & _MASK32), range_)
    return low << _U(32), range_ << _U(32)


def _encode_lanes(ids: np.ndarray, lengths: np.ndarray, order0: _Order0) -> list[bytes]:
    """ids: (lanes, steps) uint32; lengths fall from lane to lane by at most the last one's shortness."""
    lanes, steps = ids.shape
    m = _Model(lanes, order0)
    out, pos = np.zeros((lanes, steps + 64), np.uint32), np.zeros(lanes, np.int64)
    columns = np.ascontiguousarray(ids.T)

    def emit(at: np.ndarray) -> None:
        nonlocal out
        small = np.flatnonzero(m.range < _SMALL) if at is everyone else at[m.range[at] < _SMALL]
        if len(small):
            if pos.max() + 4 >= out.shape[1]:
                out = np.concatenate([out, np.zeros_like(out)], axis=1)
            out[small, pos[small]] = (m.low[small] >> _U(32)).astype(np.uint32)
            pos[small] += 1
            m.low[small], m.range[small] = _shift(m.low[small], m.range[small])

    everyone, shortest = m.lane, int(lengths.min())
    for step in range(steps):
        now = columns[step]
        live = everyone if step < shortest else np.flatnonzero(step < lengths)
        two, three = m.predict()
        hit2 = (m.g2 == now) & (m.c2 > 0)
        hit1 = ~hit2 & (m.g1 == now) & (three > two)
        begin = np.where(hit2, _U(0), np.where(hit1, two, three))
        end = np.where(hit2, two, np.where(hit1, three, _U(65536)))
        unit = m.range >> _U(16)
        m.low += begin * unit
        m.range = (end - begin) * unit
        emit(live)
        miss = live[~(hit2 | hit1)[live]]
        if len(miss):
            place = order0.place[now[miss]]
            b = order0.bucket[place]
            unit = m.range[miss] // m.cum[miss, BUCKETS]
            m.low[miss] += m.cum[miss, b] * unit
            m.range[miss] = (m.cum[miss, b + 1] - m.cum[miss, b]) * unit
            emit(miss)
            unit = m.range[miss] // order0.size[b]
            m.low[miss] += (order0.starts[place] - order0.base[b]) * unit
            m.range[miss] = order0.counts[place].astype(np.uint64) * unit
            emit(miss)
            m.seen[miss, b] += 24
        m.learn(now)
        if step % RENEW == RENEW - 1:
            m.renew()
    out = np.concatenate([out, np.zeros((lanes, 4), np.uint32)], axis=1)
    out[everyone, pos] = (m.low >> _U(32)).astype(np.uint32)
    out[everyone, pos + 1] = (m.low & _MASK32).astype(np.uint32)
    return [out[k, : pos[k] + 2].astype("<u4").tobytes() for k in range(lanes)]


def _decode_lanes(parts: list[bytes], lengths: np.ndarray, order0: _Order0) -> np.ndarray:
    lanes, steps = len(parts), int(lengths.max())
    m = _Model(lanes, order0)
    widest = max(len(p) for p in parts) // 4 + 4
    words = np.zeros((lanes, widest), np.uint64)
    for k, p in enumerate(parts):
        words[k, : len(p) // 4] = np.frombuffer(p, "<u4")
    pos = np.full(lanes, 2)
    code = (words[:, 0] << _U(32)) | words[:, 1]
    ids = np.zeros((steps, lanes), np.uint32)

    def refill(at: np.ndarray) -> None:
        small = np.flatnonzero(m.range < _SMALL) if at is everyone else at[m.range[at] < _SMALL]
        if len(small):
            m.low[small], m.range[small] = _shift(m.low[small], m.range[small])
            code[small] = (code[small] << _U(32)) | words[small, np.minimum(pos[small], widest - 1)]
            pos[small] += 1

    everyone, shortest = m.lane, int(lengths.min())
    for step in range(steps):
        live = everyone if step < shortest else np.flatnonzero(step < lengths)
        two, three = m.predict()
        unit = m.range >> _U(16)
        value = (code - m.low) // np.maximum(unit, _U(1))  # lanes that have ended may have no range left
        hit2 = value < two
        hit1 = ~hit2 & (value < three)
        begin = np.where(hit2, _U(0), np.where(hit1, two, three))
        end = np.where(hit2, two, np.where(hit1, three, _U(65536)))
        m.low += begin * unit
        m.range = (end - begin) * unit
        refill(live)
        now = np.where(hit2, m.g2, m.g1)
        miss = live[~(hit2 | hit1)[live]]
        if len(miss):
            unit = m.range[miss] // m.cum[miss, BUCKETS]
            value = np.minimum((code[miss] - m.low[miss]) // unit, m.cum[miss, BUCKETS] - _U(1))
            b = (m.cum[miss, 1:] <= value[:, None]).sum(1)
            m.low[miss] += m.cum[miss, b] * unit
            m.range[miss] = (m.cum[miss, b + 1] - m.cum[miss, b]) * unit
            refill(miss)
            unit = m.range[miss] // order0.size[b]
            value = np.minimum((code[miss] - m.low[miss]) // unit, order0.size[b] - _U(1)) + order0.base[b]
            place = np.searchsorted(order0.ends, value.astype(np.int64), side="right")
            m.low[miss] += (order0.starts[place] - order0.base[b]) * unit
            m.range[miss] = order0.counts[place].astype(np.uint64) * unit
            refill(miss)
            m.seen[miss, b] += 24
            now[miss] = order0.used[place]
        ids[step] = now
        if len(live) < lanes:
            now = np.where(step < lengths, now, np.uint32(0))
        m.learn(now)
        if step % RENEW == RENEW - 1:
            m.renew()
    return ids.T


def _cut(n: int, block: int) -> np.ndarray:
    return np.array([min(block, n - k) for k in range(0, n, block)], np.int64)


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A file of `ids` (of all documents, one after another)."""
    if len(ids) and ids.max() >= MAX_ID:
        raise ValueError(f"ids must be below {MAX_ID}")
    ids = ids.astype(np.uint32)
    block = int(min(BLOCK, max(LEAST_BLOCK, -(-len(ids) // LANES))))
    order0, sizes = _Order0.of(ids), _cut(len(ids), block)
    padded = np.zeros(len(sizes) * block, np.uint32)
    padded[: len(ids)] = ids
    table = padded.reshape(-1, block)
    parts: list[bytes] = []
    for k in range(0, len(sizes), LANES):
        own = sizes[k : k + LANES]
        parts += _encode_lanes(table[k : k + LANES, : own.max()], own, order0)
    about = {"tokens": len(ids), "block": block, "docs": len(lengths), "used": len(order0.used)}
    arrays = [
        np.diff(order0.used.astype(np.int64), prepend=0).astype("<u4"), order0.counts.astype("<u4"),
        np.array([i or 0 for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8), np.asarray(lengths).astype("<u8"),
    ]
    header = zlib.compress(json.dumps(about).encode() + b"\n" + b"".join(a.tobytes() for a in arrays), 6)
    checks = [zlib.crc32(ids[k : k + block].astype("<u4").tobytes()) for k in range(0, len(ids), block)]
    directory = np.array([[len(p) // 4, zlib.crc32(p), c] for p, c in zip(parts, checks, strict=True)], "<u4").reshape(-1, 3)
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), zlib.crc32(header).to_bytes(4, "little"), header, directory.tobytes(), *parts])


def unpack(data: bytes, blocks: range | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids): ids of all blocks, or of a range of them. Checksums that differ raise ValueError."""
    size, check = int.from_bytes(data[8:12], "little"), int.from_bytes(data[12:16], "little")
    header = data[16 : 16 + size]
    if data[:8] != MAGIC or zlib.crc32(header) != check:
        raise ValueError("not a token file, or its header is damaged")
    line, _, rest = zlib.decompress(header).partition(b"\n")
    about, at = json.loads(line), 0

    def array(kind: str, n: int) -> np.ndarray:
        nonlocal at
        at += n * np.dtype(kind).itemsize
        return np.frombuffer(rest[at - n * np.dtype(kind).itemsize : at], kind)

    used, counts = np.cumsum(array("<u4", about["used"]).astype(np.int64)).astype(np.uint32), array("<u4", about["used"])
    doc_ids, nulls, lengths = array("<i8", about["docs"]), array("u1", about["docs"]), array("<u8", about["docs"])
    order0, sizes = _Order0(used, counts), _cut(about["tokens"], about["block"])
    directory = np.frombuffer(data, "<u4", 3 * len(sizes), 16 + size).reshape(-1, 3)
    starts = 16 + size + 12 * len(sizes) + 4 * np.concatenate([[0], np.cumsum(directory[:, 0].astype(np.int64))])
    wanted = blocks if blocks is not None else range(len(sizes))
    out = [np.zeros(0, np.uint32)]
    for k in range(wanted.start, wanted.stop, LANES):
        these = range(k, min(k + LANES, wanted.stop))
        parts = [data[starts[b] : starts[b + 1]] for b in these]
        for b, p in zip(these, parts, strict=True):
            if zlib.crc32(p) != directory[b, 1]:
                raise ValueError(f"block {b} is damaged")
        found = _decode_lanes(parts, sizes[these.start : these.stop], order0)
        for b, row in zip(these, found, strict=True):
            own = row[: sizes[b]]
            if zlib.crc32(own.astype("<u4").tobytes()) != directory[b, 2]:
                raise ValueError(f"block {b} decodes to other ids")
            out.append(own)
    return [None if x else int(i) for i, x in zip(doc_ids, nulls, strict=True)], lengths.astype(np.int64), np.concatenate(out)


def in_order(names: list[str]) -> list[str]:
    """Files by their number: beyond 999,999 it has more digits."""
    return sorted(names, key=lambda n: int(n.removeprefix("part-").removesuffix(".twt")))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, file_chars: int = 16_000_000) -> dict[str, int]:
    """Write all texts' ids, each text's followed by `end_id`, in ascending order of id, below `path` (shared by all machines).

    Returns each file's name with the number of ids before it (also written as manifest.json). Null ids come first, rows
    of one id go by a hash of their texts, a null text is an empty one. A file is one task's range of ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(text_col).alias("key"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = rows.repartitionByRange(max(1, -(-chars // file_chars)), F.col("id").asc_nulls_first(), "key").sortWithinPartitions(F.col("id").asc_nulls_first(), "key")
    fs, inner = pafs.FileSystem.from_uri(path)
    fs.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        doc_ids, parts, sizes = [], [], []
        for part in pieces(batches, "text", SLICE):
            ends, own = encoder(tokenizer_path).encode_arrays(part.column("text"))
            doc_ids += part.column("id").to_pylist()
            parts.append(np.insert(own, ends[1:], end_id))
            sizes.append(np.diff(ends) + 1)
        if not parts:
            return
        ids, lengths = np.concatenate(parts), np.concatenate(sizes)
        parts.clear()
        name = f"part-{context.partitionId():06d}.twt"
        fs, inner = pafs.FileSystem.from_uri(path)
        with fs.open_output_stream(f"{inner}/{name}.{context.taskAttemptId()}.tmp") as f:
            f.write(pack(ids, doc_ids, lengths))
        fs.move(f"{inner}/{name}.{context.taskAttemptId()}.tmp", f"{inner}/{name}")  # a retried task writes the same again
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], names=["name", "tokens"])

    found = rows.select("id", "text").mapInArrow(write, "name string, tokens long").collect()  # a row per file
    bases, at = {}, 0
    found = dict(found)
    for name in in_order(list(found)):
        tokens = found[name]
        bases[name] = at
        at += tokens
    with fs.open_output_stream(f"{inner}/manifest.json") as f:
        f.write(json.dumps({"files": bases, "tokens": at, "end_id": end_id}).encode())
    return bases


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids with its end id, and how many ids all documents before it have."""
    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{inner}/manifest.json") as f:
        bases = json.loads(f.read())["files"]
    if not bases:
        return spark.createDataFrame([], "doc_id long, start long, ids array<int>")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.twt").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base = bases[batch.column("name")[row].as_py()]
                doc_ids, lengths, ids = unpack(batch.column("content")[row].as_buffer().to_pybytes())
                ends = np.concatenate([[0], np.cumsum(lengths)])
                for k in range(0, len(lengths), 1024):
                    own = ends[k : k + 1025]
                    listed = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(ids[own[0] : own[-1]].view(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[k : k + 1024], pa.int64()), pa.array(base + own[:-1]), listed], names=["doc_id", "start", "ids"])

    return files.mapInArrow(read, T.StructType.fromDDL("doc_id long, start long, ids array<int>"))
