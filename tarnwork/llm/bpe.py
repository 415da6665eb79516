"""BPE encoding and decoding by tree concatenation.

The unit of a text is the run between ASCII white space, which the tokenizer drops and never merges across: each different run of a
slice of texts is encoded once, and a text's ids are those of its runs. A run longer than `leaf` characters (text that nothing
splits) is halved until its parts are short. The parts are encoded in parallel (in one call of the tokenizer's threads), then joined pairwise, all
joins of a level in parallel: a window around each join is encoded again and grows until its outermost parts on both
sides agree exactly with what is already there. The window starts and ends at tokens; a token with the same id at the
same place in the window and in the half is a point of agreement, as a sequence of tokens is the encoding of its text
exactly if each pair of neighbours is the encoding of the pair's text. Of tokenizers whose runs are not independent, whole texts are such runs.

Defined results: a null text is an empty one and has no ids; null ids decode to an empty text; rows keep their other
columns, and repeated rows their repetition. An existing column of an output's name is replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnwork.llm.common import pieces, slices

RUN = re.compile("[^ \t\n\r\x0b\x0c]+")
#: Bytes of text encoded at a time.
SLICE = 2_000_000
#: Runs remembered by a worker since it last forgot; those used lately outlive a forgetting.
MEMORY = 120_000


#: Letters that normalisation leaves one by one, perhaps with one mark that ends the run.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?|]?)")
#: A tokenizer of this make takes a plain run's letters, in lower case, as one word for its merges, and the mark as another.
_PLAIN_NORMALIZERS = {"NFC", "Replace", "Lowercase"}
_PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


def _stable(ch: str) -> bool:
    """Whether normalisation never joins this character to the one before it."""
    return ch < "̀" or "一" <= ch <= "鿿"


class TreeEncoder:
    """Encodes as `Tokenizer.encode(text, add_special_tokens=False).ids`."""

    def __init__(self, path: str, leaf: int = 4096, window: int = 32) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["truncation"] = spec["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        # Runs are independent if white space splits, is dropped, and no added token reaches across it.
        self.by_run = '"Removed"' in json.dumps(spec["pre_tokenizer"]) and not any(a["lstrip"] or a["rstrip"] or RUN.fullmatch(a["content"]) is None for a in spec["added_tokens"])
        parts = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.plain = self.by_run and {x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])} == _PLAIN_NORMALIZERS and [x["pattern"].get("Regex") for x in parts] == [_PLAIN_SPLIT]
        self.letters, self.words = _byte_letters(), {}
        self.leaf, self.window = leaf, window
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    # -- tokens of one unsplit run -------------------------------------------------

    def _tokens(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [[(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)] for e in found]

    def tokens(self, text: str, leaf: int | None = None) -> list[tuple[int, int, int]]:
        """(id, start, end) of a text: leaves in one parallel call, then level by level, all joins of a level in parallel."""
        leaf = leaf or self.leaf
        cuts = [0, len(text)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
        parts = [[(i, a + s, a + e) for i, s, e in found] for a, found in zip(cuts, self._tokens([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]), strict=False)]
        while len(parts) > 1:
            joins = {k: self.window for k in range(0, len(parts) - 1, 2)}
            joined: dict[int, list[tuple[int, int, int]]] = {}
            while joins:
                edges = {k: self._edges(parts[k], parts[k + 1], cuts[k], cuts[k + 1], cuts[k + 2], size) for k, size in joins.items()}
                found = dict(zip(edges, self._tokens([text[a:b] for a, b in edges.values()]), strict=True))
                for k, (a, b) in edges.items():
                    window = [(i, a + s, a + e) for i, s, e in found[k]]
                    whole = self._agreed(text, parts[k], window, parts[k + 1], cuts[k + 1], a == cuts[k], b == cuts[k + 2])
                    if whole is None:
                        joins[k] *= 2
                    else:
                        joined[k] = whole
                        del joins[k]
            parts = [joined.get(k, parts[k]) for k in range(0, len(parts), 2)]
            cuts = [*cuts[:-1:2], cuts[-1]]
        return parts[0]

    @staticmethod
    def _edges(left: list, right: list, start: int, cut: int, end: int, size: int) -> tuple[int, int]:
        a = next((s for _, s, _ in reversed(left) if s <= cut - size), start)
        b = next((e for _, _, e in right if e >= cut + size), end)
        return a, b

    @staticmethod
    def _agreed(text: str, left: list, window: list, right: list, cut: int, from_start: bool, to_end: bool) -> list | None:
        """Left up to a token that the window has too, the window, and right from such a token on; None if a side differs."""

        def clean(tokens: list, at: int) -> bool:
            return at == 0 or at == len(tokens) or (tokens[at - 1][2] <= tokens[at][1] and _stable(text[tokens[at][1]]))

        first, last = (0, 0), (len(window), len(right))
        if not from_start:
            places = {t: k for k, t in enumerate(left) if t[2] <= cut}
            both = [(k, places[t]) for k, t in enumerate(window) if t[2] < cut and t in places]
            both = [(k, p) for k, p in both if k + 1 < len(window) and p + 1 < len(left) and clean(window, k + 1) and clean(left, p + 1) and clean(window, k)]
            if not both:
                return None
            first = (both[-1][0] + 1, both[-1][1] + 1)
        if not to_end:
            places = {t: k for k, t in enumerate(right) if t[1] >= cut}
            both = [(k, places[t]) for k, t in enumerate(window) if k >= first[0] and t[1] > cut and t in places]
            both = [(k, p) for k, p in both if k > 0 and p > 0 and clean(window, k) and clean(right, p) and clean(window, k + 1)]
            if not both:
                return None
            last = both[0]
        return [*left[: first[1]], *window[first[0] : last[0]], *right[last[1] :]]

    # -- runs of a text --------------------------------------------------------------

    def learn(self, runs: set[str]) -> None:
        """Encode unseen runs, all in one parallel call."""
        new = []
        for run in runs:
            if run not in self.known:
                if run in self.before:
                    self.known[run] = self.before[run]
                else:
                    new.append(run)
        if self.plain:
            new = [r for r in new if not self._learn_plain(r)]
        short = [r for r in new if len(r) <= self.leaf]
        for run, e in zip(short, self.tokenizer.encode_batch(short, add_special_tokens=False), strict=True):
            self.known[run] = np.array(e.ids, "<u4").tobytes()
        for run in new:
            if len(run) > self.leaf:
                self.known[run] = np.array([t[0] for t in self.tokens(run)], "<u4").tobytes()

    def _learn_plain(self, run: str) -> bool:
        """Learn a run that needs none of the tokenizer's splitting, if it is one: its letters go straight to the merges."""
        found = PLAIN.fullmatch(run)
        if found is None or len(run) > self.leaf:
            return False
        out = b""
        for part in found[1].lower(), found[2]:
            if part not in self.words:
                if len(self.words) > MEMORY:
                    self.words.clear()
                tokens = self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.letters)) if part else []
                self.words[part] = array("I", [t.id for t in tokens]).tobytes()
            out += self.words[part]
        self.known[run] = out
        return True

    def encode_arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): the ids of all texts, one after another, and where each text's end (from 0 on, so one more than texts)."""
        if not self.by_run:
            parts = [[t[0] for t in self.tokens(x)] if x else [] for x in texts.to_pylist()]
            return np.cumsum([0, *map(len, parts)]), np.array([i for part in parts for i in part], np.uint32)
        if len(self.known) > MEMORY:  # only here: a slice finds again what it has learnt
            self.known, self.before = {}, self.known
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, sizes = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = flat.dictionary_encode()
        runs, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.learn({r for r in runs if r})
        packed = [self.known[r] if r else b"" for r in runs]  # white space at a text's end leaves an empty run there
        lengths = np.array([len(x) // 4 for x in packed], np.int64)
        values, starts = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(lengths) - lengths
        upto = np.concatenate([[0], np.cumsum(lengths[place])]) if len(place) else np.zeros(1, np.int64)
        at = np.repeat(starts[place] - upto[:-1], lengths[place]) + np.arange(upto[-1])
        return upto[np.concatenate([[0], np.cumsum(sizes)])], values[at]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ends, ids = self.encode_arrays(pa.array(texts, pa.string()))
        data = ids.astype("<u4").tobytes()
        return [data[4 * i : 4 * j] for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


class Decoder:
    """Decodes as `Tokenizer.decode(ids, skip_special_tokens=False)`."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self.tokenizer.decoder is None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.table = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.strings = pa.array(self.table, pa.string())

    def decode_arrays(self, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of ids, each up to the next of `ends`."""
        if not self.plain or None in self.table:
            return pa.array([self.decode(ids[i:j]) for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.string())
        parts = self.strings.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), parts), " ")

    def decode(self, ids: np.ndarray) -> str:
        if not self.plain:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(x for x in map(self.table.__getitem__, ids.tolist()) if x is not None)


_encoders: dict[tuple, TreeEncoder] = {}
_decoders: dict[str, Decoder] = {}


def encoder(path: str, leaf: int = 4096) -> TreeEncoder:
    """This worker's encoder; workers are reused, so what it has learnt serves later tasks."""
    if (path, leaf) not in _encoders:
        _encoders[path, leaf] = TreeEncoder(path, leaf)
    return _encoders[path, leaf]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def list_array(ends: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    """A list column of ids."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype("<u4").view(np.int32)))


def binary_array(ends: np.ndarray, ids: np.ndarray) -> pa.Array:
    """A column of ids as little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids.astype("<u4")))])


def _ids_type(packed: bool) -> T.DataType:
    return T.BinaryType() if packed else T.ArrayType(T.IntegerType())


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", leaf: int = 4096, keep_text: bool = True, packed: bool = False, decoded_col: str | None = None) -> DataFrame:
    """`df` with the token ids of each text: an array of int, or `packed` as little-endian unsigned 32-bit integers.

    `decoded_col` adds the text that the ids decode to, in the same pass. Narrow: no shuffle, and memory bounded by a slice of rows.
    """
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    rest = [c for c in df.columns if c not in new and (keep_text or c != text_col)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(ids_col, _ids_type(packed)), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(tokenizer_path, leaf)
        for part in pieces(batches, text_col, SLICE):
            ends, ids = tree.encode_arrays(part.column(text_col))
            out = [(binary_array if packed else list_array)(ends, ids)]
            if decoded_col:
                out.append(decoder(tokenizer_path).decode_arrays(ends, ids))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *out], names=[*rest, *new])

    return df.select(*dict.fromkeys([*rest, text_col])).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`df` with the text of each row's token ids (array or packed)."""
    rest = [c for c in df.columns if c != text_col]
    packed = isinstance(df.schema[ids_col].dataType, T.BinaryType)
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [np.frombuffer(x or b"", "<u4") if packed else np.array(x or [], np.uint32) for x in part.column(ids_col).to_pylist()]
            ends = np.cumsum([0, *map(len, own)])
            texts = decoder(tokenizer_path).decode_arrays(ends, np.concatenate([np.zeros(0, np.uint32), *own]))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), texts], names=[*rest, text_col])

    return df.mapInArrow(run, schema)
