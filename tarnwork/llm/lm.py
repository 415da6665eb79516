"""An n-gram language model in an Elias-Fano trie, built and queried in shards.

Level 1 holds the words' hashes in order (a word's id is its rank), level 2 the second words below each first, level 3 the
third ones. Within a level, the words below one context are in order of id; with the context's place added they are one monotone
sequence for all contexts, coded by Elias-Fano, as are the pointers from a context to where its words begin. A lookup goes from
a context by its pointers to its range and there to the successor of the word sought. Probabilities and back-off weights are
quantised to two bytes each (steps of a logarithm). Files are read through memory maps where the file system is local, so that workers share
their pages; elsewhere a worker holds files of at most HELD bytes at a time.

Smoothing is interpolated absolute discounting: the probability of a word is its n-gram's count less D over the context's count
(the trie holds this, quantised), plus the context's weight times the probability without the first word, down to add-a-half over single
words. The weight of a context with m different next words is D * m over its count, so each context's probabilities sum to
one (but for quantisation). All n-grams are kept, also those that occur once.

Counting is over all training texts: slices of texts are counted in their tasks, and packed blocks of counts go to the task of
their shard, one shuffle for words and one for n-grams (of three words; those of two are their sums, as each text's last pair has a mark for a
third word). Words are split over shards by hash, n-grams by their first word; those of a frequent first word are split by
their second word instead, and every shard knows these contexts. Only numbers per shard, and at most 65,536 frequent words,
reach the driver.

Defined results: a null text is an empty one, which has its end only; rows of any id are scored on their own; a very long text is
a slice of its own; with no training texts every probability is that of an unknown word; words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.llm.common import pieces, scratch_path

D = 0.75
#: Bytes of text that a task counts or scores at a time.
SLICE = 6_000_000
#: Most different words that a slice's words are ranked among, when n-grams are counted.
RANKS = 21
#: Steps per power of ten, in quantised probabilities: at most 0.12 % off.
STEP = 1 / 1000
#: Most frequent first words whose n-grams are dealt out by the second word.
MOST_HOT = 65_536
#: Rows looked up at a time, so that intermediate arrays stay in the processor's cache.
ROWS = 1 << 14
#: Bytes of files that a worker holds where it can't map them.
HELD = 256 << 20
_U = np.uint64
_ONE, _ALL = _U(1), _U(0xFFFFFFFFFFFFFFFF)
#: Marks no text can hold as words, as they contain white space.
START, END = xxhash.xxh3_64_intdigest(b"\n<"), xxhash.xxh3_64_intdigest(b"\n>")

#: Place of the k-th set bit of a byte, at 8 * byte + k.
_IN_BYTE = np.array([next((p for p in range(8) if b >> p & 1 and bin(b & ((1 << p) - 1)).count("1") == k), 0) for b in range(256) for k in range(8)], np.int64)
_H5, _H3, _HF, _H1, _H8 = (_U(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, one after another, in 64-bit words."""
    out = [np.zeros(0, np.uint8)]
    for k in range(0, len(values) if width else 0, 1 << 16):
        bits = np.unpackbits(values[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=width)
        out.append(np.packbits(bits, bitorder="little"))
    flat = np.concatenate(out)
    return np.concatenate([flat, np.zeros(-len(flat) % 8 + 16, np.uint8)]).view(np.uint64)


class EliasFano:
    """A monotone sequence of unsigned 64-bit integers."""

    def __init__(self, about: dict, arrays: dict[str, np.ndarray], name: str) -> None:
        self.n, self.low_bits = about[name]["n"], about[name]["low"]
        self.low, self.high, self.ones, self.hint0, self.hint1 = (arrays[f"{name}.{part}"] for part in ("low", "high", "ones", "hint0", "hint1"))
        self.mask = _U((1 << self.low_bits) - 1)

    @staticmethod
    def build(values: np.ndarray, top: int, name: str, about: dict, arrays: dict[str, np.ndarray]) -> None:
        n = len(values)
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        about[name] = {"n": n, "low": low}
        bits = np.zeros(-(-(n + (top >> low) + 2) // 64) * 64, np.uint8)
        places = (values >> _U(low)).astype(np.int64) + np.arange(n)
        bits[places] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        arrays[f"{name}.high"], arrays[f"{name}.ones"] = words, ones.astype(np.uint32 if n < 1 << 32 else np.int64)
        last = np.array([len(words) - 1])
        arrays[f"{name}.hint1"] = np.concatenate([places[::64] >> 6, last]).astype(np.uint32)
        arrays[f"{name}.hint0"] = np.concatenate([np.flatnonzero(bits == 0)[::64] >> 6, last]).astype(np.uint32)
        arrays[f"{name}.low"] = _bits(values, low)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << _ONE) << (_U(63) - shift))) & self.mask

    def _before(self, word: np.ndarray, zeros: bool) -> np.ndarray:
        found = self.ones[word].astype(np.int64)
        return (word << 6) - found if zeros else found

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th (from 0) bit that is set, or not set."""
        hint = self.hint0 if zeros else self.hint1
        word = hint[k >> 6].astype(np.int64)
        behind = np.flatnonzero(self._before(word + 1, zeros) <= k)
        if len(behind):  # a step, then bisection up to the next hint
            own = k[behind]
            lo, hi = word[behind] + 1, hint[(own >> 6) + 1].astype(np.int64)
            on = np.flatnonzero(self._before(lo + 1, zeros) <= own)
            lo[on] += 1
            while len(on := np.flatnonzero(lo < hi)):
                mid = (lo[on] + hi[on]) >> 1
                up = self._before(mid + 1, zeros) <= own[on]
                lo[on], hi[on] = np.where(up, mid + 1, lo[on]), np.where(up, hi[on], mid)
            word[behind] = lo
        left = (k - self._before(word, zeros)).astype(np.uint64)
        x = self.high[word]
        if zeros:
            x = ~x
        s = x - ((x >> _ONE) & _H5)
        s = (s & _H3) + ((s >> _U(2)) & _H3)
        upto = ((s + (s >> _U(4))) & _HF) * _H1  # byte j: how many are set in bytes 0 to j
        byte = 8 - np.bitwise_count(((upto | _H8) - (left + _ONE) * _H1) & _H8).astype(np.int64)
        shift = (byte << 3).astype(np.uint64)
        inside = left - (((upto << _U(8)) >> shift) & _U(255))
        place = _IN_BYTE[((((x >> shift) & _U(255)) << _U(3)) + inside).astype(np.int64)]
        return (word << 6) + (byte << 3) + place

    @staticmethod
    def _first(x: np.ndarray) -> np.ndarray:
        """Place of the lowest set bit (64 where none is)."""
        return np.bitwise_count((x & (~x + _ONE)) - _ONE).astype(np.int64)

    def successor(self, values: np.ndarray, from_: np.ndarray | None = None, to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value not below each, among those of its high part; whether it is equal), within [from_, to) where given."""
        h = np.minimum((values >> _U(self.low_bits)).astype(np.int64), 64 * len(self.high) - self.n - 1)
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) + 1, 0)
        lo = begin - h
        rest = ~self.high[begin >> 6] >> (begin & 63).astype(np.uint64)
        hi = lo + self._first(rest)
        far = np.flatnonzero(rest == 0)
        hi[far] = self._select(h[far], True) - h[far]
        if from_ is not None:
            lo, hi = np.maximum(lo, from_), np.minimum(hi, to)
        sought, last = values & self.mask, hi.copy()
        on = np.flatnonzero(lo < hi)
        while len(on):
            a, b = lo[on], hi[on]
            mid = (a + b) >> 1
            below = self._low(mid) < sought[on]
            a, b = np.where(below, mid + 1, a), np.where(below, b, mid)
            lo[on], hi[on] = a, b
            on = on[a < b]
        equal = lo < last
        equal[equal] = self._low(lo[equal]) == sought[equal]
        return lo, equal

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places."""
        return ((self._select(i, False) - i).astype(np.uint64) << _U(self.low_bits)) | self._low(i)

    def range(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at each place and the next, as signed integers: a context's range from its pointers."""
        at = self._select(i, False)
        rest = (self.high[at >> 6] >> (at & 63).astype(np.uint64)) >> _ONE
        after = at + 1 + self._first(rest)
        far = np.flatnonzero(rest == 0)
        after[far] = self._select(i[far] + 1, False)
        values = (((p - k).astype(np.uint64) << _U(self.low_bits)) | self._low(k) for p, k in ((at, i), (after, i + 1)))
        return tuple(v.astype(np.int64) for v in values)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-65)) / STEP), 0, 65535).astype(np.uint16)


_POWERS = 10.0 ** (-STEP * np.arange(65536))


def save(path: str, about: dict, arrays: dict[str, np.ndarray]) -> None:
    fs, inner = pafs.FileSystem.from_uri(path)
    at, places = 0, {}
    for name, a in arrays.items():
        places[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"about": about, "arrays": places}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    from pyspark import TaskContext

    context = TaskContext.get()
    own = f"{inner}.{context.taskAttemptId() if context else 0}.tmp"
    with fs.open_output_stream(own) as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 64))
    fs.move(own, inner)  # a retried task writes the same again


def load(path: str) -> tuple[dict, dict[str, np.ndarray], int]:
    """A file's description and arrays, and the bytes of memory that it takes (none if it is mapped)."""
    fs, inner = pafs.FileSystem.from_uri(path)
    mapped = isinstance(fs, pafs.LocalFileSystem)
    if mapped:
        data = np.memmap(inner, np.uint8, "r")
    else:
        with fs.open_input_file(inner) as f:
            data = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    base = 8 + size
    arrays = {k: np.asarray(data[base + at : base + at + n * np.dtype(kind).itemsize]).view(kind) for k, (kind, n, at) in head["arrays"].items()}
    return head["about"], arrays, 0 if mapped else len(data)


@dataclass
class Model:
    """Where a trie is, and the figures that all its readers need."""

    path: str
    bits: int
    words: list[int]
    tokens: int
    distinct: int
    #: Ids, in order, of frequent words, how often each occurs, and how many different words follow each.
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_next: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def shards(self) -> int:
        return 1 << self.bits

    @property
    def width(self) -> int:
        return sum(self.words) + 1


@dataclass
class Words:
    """What is known of different words: id (-1 if unknown), count, shard, rank among the frequent ones (or -1)."""

    ids: np.ndarray
    counts: np.ndarray
    shards: np.ndarray
    hot: np.ndarray


class Trie:
    """A worker's view of a model; files are opened when first used."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.bases = np.concatenate([[0], np.cumsum(model.words)]).astype(np.int64)
        self.parts: dict[str, tuple] = {}
        self.held = 0

    def part(self, name: str) -> tuple[dict, dict[str, np.ndarray], dict[str, EliasFano]]:
        if name not in self.parts:
            about, arrays, size = load(f"{self.model.path}/{name}")
            if self.held + size > HELD:
                self.parts.clear()
                self.held = 0
            self.held += size
            self.parts[name] = (about, arrays, {k: EliasFano(about, arrays, k) for k in about})
        return self.parts[name]

    def look_up(self, hashes: np.ndarray) -> Words:
        m, n = self.model, len(hashes)
        shards = (hashes >> _U(64 - m.bits)).astype(np.int64) if m.bits else np.zeros(n, np.int64)
        ids, counts = np.full(n, -1), np.zeros(n, np.int64)
        for s, at in _groups(shards):
            if m.words[s]:
                _, arrays, coded = self.part(f"level1-{s:06d}")
                place, found = coded["hash"].successor(hashes[at] & _U((1 << (64 - m.bits)) - 1))
                ids[at[found]] = place[found] + self.bases[s]
                counts[at[found]] = arrays["count"][place[found]]
        hot = np.full(n, -1)
        if len(m.hot):
            place = np.minimum(np.searchsorted(m.hot, ids), len(m.hot) - 1)
            hot = np.where(m.hot[place] == ids, place, -1)
        return Words(ids, counts, shards, hot)

    def one(self, counts: np.ndarray) -> np.ndarray:
        """Probability of a word by its count."""
        return (counts + 0.5) / (self.model.tokens + 0.5 * (self.model.distinct + 1))

    def contexts(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in the shard, begin, end, weight) of each word as a first one; begin and end are 0 for frequent ones, which have a range in every shard."""
        n = len(w.ids)
        local, begin, end, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n)
        plain = np.flatnonzero((w.ids >= 0) & (w.hot < 0))
        for s, k in _groups(w.shards[plain]):
            at = plain[k]
            local[at] = w.ids[at] - self.bases[s]
            begin[at], end[at] = self.part(f"ngrams-{s:06d}")[2]["pointer2"].range(local[at])
            weight[at] = D * (end[at] - begin[at]) / w.counts[at]
        often = np.flatnonzero(w.hot >= 0)
        weight[often] = D * self.model.hot_next[w.hot[often]] / w.counts[often]
        weight[w.ids < 0] = 1.0
        return local, begin, end, weight

    def hot_ranges(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of frequent first words in a shard."""
        part = self.part(f"ngrams-{s:06d}")
        if "_hot" not in part[0]:
            part[0]["_hot"] = part[2]["pointer2"].range(self.model.words[s] + np.arange(len(self.model.hot)))
        return part[0]["_hot"]

    def score(self, seq: np.ndarray, firsts: np.ndarray, w: Words) -> np.ndarray:
        """log10 probability of each token of texts, given the two before it. seq: places in w, each text begun by a start mark (at `firsts`)."""
        m, n = self.model, len(seq)
        local, begin, end, weight = self.contexts(w)
        p = self.one(w.counts)[seq]
        # Pairs: k stands for the pair of tokens k - 1 and k.
        k = np.ones(n, bool)
        k[firsts] = False
        k = np.flatnonzero(k)
        k = k[w.ids[seq[k - 1]] >= 0]
        first = seq[k - 1]
        p[k] *= weight[first]
        k = k[w.ids[seq[k]] >= 0]
        first = seq[k - 1]
        shard = np.where(w.hot[first] >= 0, w.ids[seq[k]] % m.shards, w.shards[first])
        pair, home, back = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        for s, j in _groups(shard, ROWS):
            _, arrays, coded = self.part(f"ngrams-{s:06d}")
            at, a = k[j], first[j]
            place, lo, hi = local[a], begin[a], end[a]
            often = np.flatnonzero(w.hot[a] >= 0)
            if len(often):
                rank = w.hot[a[often]]
                hot_begin, hot_end = self.hot_ranges(s)
                place[often], lo[often], hi[often] = m.words[s] + rank, hot_begin[rank], hot_end[rank]
            place, found = coded["child2"].successor(place.astype(np.uint64) * _U(m.width) + w.ids[seq[at]].astype(np.uint64), lo, hi)
            at, place = at[found], place[found]
            p[at] += _POWERS[arrays["p2"][place]]
            pair[at], home[at], back[at] = place, s, _POWERS[arrays["back2"][place]]
        # Triples: k stands for tokens k - 2, k - 1 and k.
        k = np.ones(n, bool)
        k[firsts] = False
        k[np.minimum(firsts + 1, n - 1)] = False
        k = np.flatnonzero(k)
        k = k[pair[k - 1] >= 0]
        p[k] *= back[k - 1]
        k = k[w.ids[seq[k]] >= 0]
        for s, j in _groups(home[k - 1], ROWS):
            _, arrays, coded = self.part(f"ngrams-{s:06d}")
            at = k[j]
            place = pair[at - 1]
            lo, hi = coded["pointer3"].range(place)
            place, found = coded["child3"].successor(place.astype(np.uint64) * _U(m.width) + w.ids[seq[at]].astype(np.uint64), lo, hi)
            p[at[found]] += _POWERS[arrays["p3"][place[found]]]
        p[firsts] = 1.0
        return np.log10(p)


def _groups(shard: np.ndarray, most_rows: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its rows), cut after `most_rows` where given."""
    if not len(shard):
        return
    most = int(shard.max())
    by = np.argsort(shard.astype(np.uint16) if most < 65536 else shard, kind="stable")  # 16 bits are sorted by radix
    own = shard[by]
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for k in range(a, b, most_rows or b - a):
            yield int(own[a]), by[k : min(b, k + (most_rows or b - a))]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seq, firsts, hashes): texts as places in `hashes`, each between a start (0) and an end (1), and where each begins."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, lengths = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    if not real.all():  # white space at an end leaves an empty word there
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[real], minlength=len(lengths))
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()).to_pylist()
    hashes = np.array([START, END, *map(xxhash.xxh3_64_intdigest, words)], np.uint64)
    ends = np.cumsum(lengths + 2)
    firsts = ends - lengths - 2
    seq = np.full(int(ends[-1]) if len(ends) else 0, 0, np.int64)
    inner = np.ones(len(seq), bool)
    inner[firsts] = inner[ends - 1] = False
    seq[inner] = coded.indices.to_numpy() + 2
    seq[ends - 1] = 1
    return seq, firsts, hashes


def _summed(k: np.ndarray, c: np.ndarray | None, n: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(k, c) in order, each once, with the sum of its n."""
    if not len(k):
        return k, c, n
    by = np.argsort(k)
    k, n = k[by], n[by]
    change = np.concatenate([[True], k[1:] != k[:-1]])
    if c is not None:  # rank k, so that both fit one integer
        both = ((np.cumsum(change) - 1).astype(np.uint64) << _U(32)) | c[by].astype(np.uint64)
        again = np.argsort(both)
        both, k, n = both[again], k[again], n[again]
        change = np.concatenate([[True], both[1:] != both[:-1]])
        c = (both & _U(0xFFFFFFFF)).astype(np.uint32)
    new = np.flatnonzero(change)
    return k[new], None if c is None else c[new], np.add.reduceat(n, new)


def _packed(k: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    """Counts in order of k: steps of k, c and n by bytes of the same weight, compressed."""
    arrays = np.diff(k, prepend=_U(0)), c.astype(np.uint32), n.astype(np.uint32)
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(k), -1).T.tobytes() for x in arrays)
    return len(k).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(block[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(block[8:], 16 * size, asbytes=True), np.uint8)
    step, c, n = (np.ascontiguousarray(planes[a * size : b * size].reshape(b - a, size).T).view(kind).ravel() for a, b, kind in ((0, 8, np.uint64), (8, 12, np.uint32), (12, 16, np.uint32)))
    return np.cumsum(step, dtype=np.uint64), c, n.astype(np.int64)


def _blocks(shard: np.ndarray, k: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row per shard; rows stay in order within one."""
    found = [(s, _packed(k[at], c[at], n[at])) for s, at in _groups(shard)]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["shard", "block"])


def _unigrams(docs: DataFrame, bits: int) -> DataFrame:
    """(shard, block): how often each word occurs in a task's texts, k being its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, _, n = _summed(np.concatenate([x for x, _ in held]), None, np.concatenate([x for _, x in held]))
            held.clear()
            shard = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            return _blocks(shard, h, np.zeros(len(h), np.uint32), n)

        for part in pieces(batches, "text", SLICE):
            seq, _, hashes = tokens(part.column("text"))
            held.append((hashes, np.bincount(seq, minlength=len(hashes))))
            if sum(len(x) for x, _ in held) > 1_000_000:
                yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "shard int, block binary")


def _ngrams(docs: DataFrame, model: Model) -> DataFrame:
    """(shard, block): all n-grams of three words, k packing the first two words' ids. A text's last pair has the largest integer for a third word."""
    none, most = 0xFFFFFFFF, (1 << RANKS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for part in pieces(batches, "text", SLICE):
            seq, firsts, hashes = tokens(part.column("text"))
            w = trie.look_up(hashes)
            by = np.argsort(w.ids)
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            ids = np.append(w.ids[by], none)
            ends = np.append(firsts[1:], len(seq)) - 1
            begins = np.ones(len(seq), bool)
            begins[ends] = False  # an n-gram begins at each token but a text's end
            at = np.flatnonzero(begins)
            k, second = rank[seq[at]], rank[seq[at + 1]]
            third = np.append(seq, 0)[at + 2]
            third = np.where(begins[at + 1], rank[third], len(by))
            if len(by) < 1 << RANKS:
                both, n = np.unique((k << (2 * RANKS)) | (second << RANKS) | third, return_counts=True)
                k, second, third = both >> (2 * RANKS), (both >> RANKS) & most, both & most
            else:  # a text of more words than there are ranks: nothing is summed here
                n, order = np.ones(len(k), np.int64), np.lexsort((second, k))
                k, second, third = k[order], second[order], third[order]
            shard = np.where(w.hot[by][k] >= 0, ids[second] % model.shards, w.shards[by][k])
            yield _blocks(shard, (ids[k].astype(np.uint64) << _U(32)) | ids[second].astype(np.uint64), ids[third], n)

    return docs.select("text").mapInArrow(run, "shard int, block binary")


def _by_blocks(df: DataFrame, shards: int, build: Callable) -> list:
    """build(shard, k, c, n) for every shard, with its counts in order; each shard is one task's. Returns what it returns: (number, number, list, list)."""
    every = df.sparkSession.createDataFrame([(s, None) for s in range(shards)], "shard int, block binary")  # each shard gets its file, if it has n-grams or not

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for s, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(s, []).extend([] if block is None else [block])
        for s in sorted(held):
            parts = [_unpacked(x) for x in held.pop(s)] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
            got = build(s, *map(np.concatenate, zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((s, *got), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=list("smnab"))

    return df.unionByName(every).repartitionById(shards, "shard").mapInArrow(run, "s long, m long, n long, a array<long>, b array<long>").collect()  # a row per shard


def build(docs: DataFrame, path: str | None = None, *, shard_tokens: int = 4_000_000) -> Model:
    """Count `docs` (text) and write the trie's files below `path`; returns what `score` takes.

    A shard is meant to have about `shard_tokens` n-grams, and first words of more than a quarter of that are dealt out over all shards.
    """
    path = path or scratch_path(docs.sparkSession, "lm")
    fs, inner = pafs.FileSystem.from_uri(path)
    fs.create_dir(inner, recursive=True)
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = int(size // 7 // shard_tokens).bit_length()
    shards = 1 << bits
    often = shard_tokens // 4

    def level1(s: int, h: np.ndarray, _: np.ndarray, n: np.ndarray) -> tuple:
        h, _, n = _summed(h, None, n)
        about: dict = {}
        arrays = {"count": n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64)}
        EliasFano.build(h & _U((1 << (64 - bits)) - 1), (1 << (64 - bits)) - 1, "hash", about, arrays)
        save(f"{path}/level1-{s:06d}", about, arrays)
        real = h != _U(START)
        hot = np.flatnonzero(n > often)
        return len(h), int(n[real].sum()), hot, n[hot]

    found = sorted(_by_blocks(_unigrams(docs, bits), shards, level1))
    words = [r["m"] for r in found]
    bases = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    tokens_ = sum(r["n"] for r in found)
    starts = docs.limit(1).count()  # the start mark is a word of level 1, but not of the texts
    hot = np.array([bases[r["s"]] + i for r in found for i in r["a"]], np.int64)
    count = np.array([n for r in found for n in r["b"]], np.int64)
    most = np.sort(np.argsort(-count, kind="stable")[:MOST_HOT])
    model = Model(path, bits, words, tokens_, int(bases[-1]) - starts, hot[most], count[most], np.zeros(len(most), np.int64))

    def ngrams(s: int, k: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple:
        a, width = (k >> _U(32)).astype(np.int64), model.width
        place = np.searchsorted(model.hot, a) if len(model.hot) else np.zeros(len(a), np.int64)
        frequent = np.append(model.hot, -1)[place] == a
        local = np.where(frequent, words[s] + place, a - bases[s])
        k, c, n = _summed((local.astype(np.uint64) << _U(32)) | (k & _U(0xFFFFFFFF)), c, n)
        contexts = words[s] + len(model.hot)
        own = Trie(model).part(f"level1-{s:06d}")[1]["count"].astype(np.int64) if words[s] else np.zeros(0, np.int64)
        total = np.concatenate([own, model.hot_count])
        # Pairs are runs of k.
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        pairs, n2 = k[new], np.add.reduceat(n, new) if len(k) else n
        context, second = (pairs >> _U(32)).astype(np.int64), pairs & _U(0xFFFFFFFF)
        about: dict = {}
        arrays: dict[str, np.ndarray] = {"p2": quantised((n2 - D) / total[context])}
        EliasFano.build(np.searchsorted(context, np.arange(contexts + 1)).astype(np.uint64), len(pairs), "pointer2", about, arrays)
        EliasFano.build(context.astype(np.uint64) * _U(width) + second, max(contexts, 1) * width, "child2", about, arrays)
        # Triples, without the mark that stands for no third word.
        real = c != 0xFFFFFFFF
        pair = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(k))))[real]
        c, n = c[real], n[real]
        arrays["p3"] = quantised((n - D) / n2[pair])
        arrays["back2"] = quantised(D * np.bincount(pair, minlength=len(pairs)) / n2)
        EliasFano.build(np.searchsorted(pair, np.arange(len(pairs) + 1)).astype(np.uint64), len(pair), "pointer3", about, arrays)
        EliasFano.build(pair.astype(np.uint64) * _U(width) + c.astype(np.uint64), max(len(pairs), 1) * width, "child3", about, arrays)
        save(f"{path}/ngrams-{s:06d}", about, arrays)
        return len(pairs), len(pair), [], np.bincount(context[context >= words[s]] - words[s], minlength=len(model.hot))

    for r in _by_blocks(_ngrams(docs, model), shards, ngrams):
        model.hot_next += np.array(r["b"], np.int64)
    return model


_tries: dict[str, Trie] = {}


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` without its text, with n_tokens, n_known, train_tokens, base_score and score."""
    new = T.StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double")
    rest = [c for c in df.columns if c != text_col and c not in new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.path not in _tries:
            _tries.clear()
            _tries[model.path] = Trie(model)
        trie = _tries[model.path]
        for part in pieces(batches, text_col, SLICE // 2):
            seq, firsts, hashes = tokens(part.column(text_col))
            w = trie.look_up(hashes)
            known = (w.counts > 0)[seq]
            base = np.log10(trie.one(w.counts))[seq]
            known[firsts] = base[firsts] = 0
            sums = [np.add.reduceat(x.astype(float), firsts) for x in (known, base, trie.score(seq, firsts, w))]
            n = np.diff(np.append(firsts, len(seq))) - 1
            cols = [pa.array(n, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *cols], names=[*rest, *new.names])

    return df.select(*rest, text_col).mapInArrow(run, T.StructType([*(df.schema[c] for c in rest), *new]))
