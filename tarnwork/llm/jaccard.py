"""N-gram Jaccard join over count vectors in R-trees.

A document is the set of its distinct word shingles, 64-bit hashes. Documents of equal sets are one class. The join of
classes with |A & B| / |A | B| of at least a percentage:

1. Each class keeps the first shingles of its set in one order for all (shingles that many documents have last, else by
   hash), as many as it takes that two linked classes share one. Only shingles that two classes share are kept; a bitmap
   of fixed size tells. Such a shingle is a bucket. (An R-tree over all documents prunes little: in as many dimensions as
   the bound needs, boxes of unrelated documents overlap, and comparing all boxes grows with the square of the input.)
2. In each bucket every class is first compared with a pivot, a few of which serve a family. Classes are points: their shingles hashed into GROUPS groups
   and counted; the sum of coordinate minima bounds an overlap from above, and pairs beyond the bound are dropped.
3. Survivors are verified on their whole texts, and linked classes are joined into components. Buckets that still hold
   several components are then joined in full but for pairs inside a component, by R-trees over the points (a bucket of up to a leaf's
   points is a tree of one box): boxes whose summed minima of upper corners can't reach the overlap that their smallest sizes need
   are dropped with all below them. A bucket of many classes is cut into blocks, and each pair of blocks is a task's work of
   bounded size.

So no link between different texts is lost, and a group of any number of near copies costs in proportion to its size.
All tables are partitioned by shingle, class or pair; only bitmaps of a fixed size leave the cluster.

Defined results: null and empty texts have empty sets, linked with nothing; a null id counts as larger than any other
(the component of null ids alone is null); rows of one id with different texts are documents of their own; repeated rows repeat.
Classes are told apart by 64-bit sums of hashes, sets by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.llm.common import as_bytes, discard, mix, shingles, slices, text_key, written
from tarnwork.llm.graph import components

#: Coordinates of a point, a byte each; a coordinate of 255 stands for any count from there on and bounds nothing.
GROUPS, FULL = 128, 255
#: Bits of the bitmaps of shingles, and of those of documents to be verified (sent anew in each round).
BITS, ID_BITS = 1 << 27, 1 << 24
#: A shingle is of many documents if counts of two or more within parts of tasks sum up to this.
OFTEN = 12
#: Pivots of a family of near copies in each round before the last, and such rounds at most. The last round is exact whatever these are.
PIVOTS, ROUNDS = 8, 2
#: Shingles that a task holds at a time to count them.
CHUNK = 2_000_000
#: Buckets of a class that its rows in the last round name; the rows of a class in more name none, or they would grow with the square of a text.
KNOWN = 24
#: Classes of a block.
BLOCK = 256


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of fewer words, one hash of all."""
    import xxhash

    words = (text or b"").lower().split()
    base = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(shingles(base, min(k, len(words)))) if words else np.zeros(0, np.uint64)


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(65 - (8 * len(bitmap)).bit_length())
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap_of(hashes: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """A bitmap of so many bits, sent to all workers: which hashes (by their first bits) `column` holds. Its size doesn't depend on the input's."""
    bit = F.shiftrightunsigned(column, 65 - bits.bit_length()) + 1
    rows = hashes.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for k, m in rows.coalesce(4).toLocalIterator():  # a job per partition
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


def class_of(h: np.ndarray) -> int:
    """A sum of hashes that tells sets apart."""
    return int(mix(h + np.uint64(len(h))).sum().view(np.int64)) if len(h) else 0


def _often(docs: DataFrame, k: int) -> DataFrame:
    """(h): shingles of many documents. Tasks count chunks of whole sets and pass on what a chunk has several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        for part in slices(batches):
            for text in as_bytes(part.column(0)):
                held.append(shingle_set(text, k))
                size += len(held[-1])
            if size > CHUNK:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).select("h")


def _sets(docs: DataFrame, k: int, percent: int, shared: Broadcast) -> DataFrame:
    """(id, n, c, first, counts): size, class, prefix in the common order and count vector of each document."""
    names = ["id", "n", "c", "first", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.frombuffer(shared.value, np.uint8)
        for part in slices(batches):
            n, c, first, counts = [], [], [], []
            for text in as_bytes(part.column("text")):
                h = shingle_set(text, k)
                n.append(len(h))
                c.append(class_of(h))
                order = np.concatenate([h[~(m := _in(many, h))], h[m]])
                first.append(order[: _prefix(len(h), percent, 100)].tobytes())
                counts.append(np.bincount((h % np.uint64(GROUPS)).astype(int), minlength=GROUPS).clip(max=FULL).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(first, pa.binary()), pa.array(counts, pa.binary())], names=names)

    schema = T.StructType([docs.schema["id"], *T.StructType.fromDDL("n long, c long, first binary, counts binary")])
    return docs.select("id", "text").mapInArrow(run, schema)


def _prefix(n: int, percent: int, of: int) -> int:
    """How many first shingles a set of n needs if the overlap is at least percent * n / of."""
    return n + percent * n // -of + 1 if n else 0


def _rows(classes: DataFrame, sent: Broadcast | None = None) -> DataFrame:
    """(h, c, n): a row per prefix shingle (that the bitmap lets through)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if sent is None else np.frombuffer(sent.value, np.uint8)
        for part in slices(batches):
            first = part.column("first").to_pylist()
            h = np.frombuffer(b"".join(first), np.uint64)
            row = np.repeat(np.arange(part.num_rows), [len(x) // 8 for x in first])
            if bitmap is not None:
                keep = _in(bitmap, h)
                h, row = h[keep], row[keep]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("c").take(take), part.column("n").take(take)], names=["h", "c", "n"])

    return classes.select("c", "n", "first").mapInArrow(run, "h long, c long, n long")


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap of linked sets of these sizes."""
    return -(-percent * (na + nb) // (100 + percent))


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, la, lb) whose summed coordinate minima reach the overlap needed, with the hashes (ha, hb) of their documents' ids."""
    names = ["a", "b", "la", "lb", "ha", "hb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            va, vb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS) for c in ("va", "vb"))
            na, nb = (part.column(c).to_numpy() for c in ("na", "nb"))
            yield part.select(names).filter(pa.array(_reaches(va, vb, na, nb, percent)))

    side = lambda x: classes.select(*(F.col(c).alias(f"{d}{x}") for c, d in (("c", ""), ("n", "n"), ("counts", "v"), ("hid", "h"))))
    return pairs.select("a", "b", "la", "lb").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _reaches(va: np.ndarray, vb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    least = np.minimum(va, vb)
    return (least.sum(1, dtype=np.int64) >= needed(na, nb, percent)) | (least == FULL).any(1)


class Tree:
    """An R-tree over count vectors, bulk-loaded by size and then by the widest coordinate."""

    LEAF, FAN = 16, 8

    def __init__(self, n: np.ndarray, v: np.ndarray) -> None:
        self.n, self.v = n, v
        wide = self.v.var(axis=0).argmax() if len(n) else 0
        tile = max(1, int(np.sqrt(max(len(n) // self.LEAF, 1)))) * self.LEAF
        order = np.argsort(n, kind="stable")
        order = np.concatenate([o[np.argsort(self.v[o, wide], kind="stable")] for o in (order[k : k + tile] for k in range(0, len(n), tile))]) if len(n) else order
        level = [self._node(order[k : k + self.LEAF], None) for k in range(0, len(n), self.LEAF)]
        while len(level) > 1:
            level = [self._node(None, level[k : k + self.FAN]) for k in range(0, len(level), self.FAN)]
        self.root = level[0] if level else None

    def _node(self, points: np.ndarray | None, below: list | None) -> tuple:
        if below is None:
            return self.v[points].max(0), self.n[points].min(), self.n[points].max(), points, None
        return np.max([b[0] for b in below], axis=0), min(b[1] for b in below), max(b[2] for b in below), None, below


def tree_join(left: Tree, right: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs (left, right) whose bound reaches the overlap needed."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(left.root, right.root)] if left.root and right.root else []
    while todo:
        p, q = todo.pop()
        least = np.minimum(p[0], q[0])
        if 100 * p[2] < percent * q[1] or 100 * q[2] < percent * p[1] or (least.sum(dtype=np.int64) < needed(p[1], q[1], percent) and least.max() < FULL):
            continue
        if p[4] is None and q[4] is None:
            a, b = np.repeat(p[3], len(q[3])), np.tile(q[3], len(p[3]))
            keep = _reaches(left.v[a], right.v[b], left.n[a], right.n[b], percent)
            out.append((a[keep], b[keep]))
        elif q[4] is None or (p[4] is not None and p[2] - p[1] >= q[2] - q[1]):
            todo += [(x, q) for x in p[4]]
        else:
            todo += [(p, x) for x in q[4]]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) between components (la, lb) of the pairs (a, b) of classes that are linked, found on the whole texts of one document of each."""
    wanted = pairs.select(F.explode(F.array("ha", "hb")).alias("hid"))
    sent = bitmap_of(wanted, "hid", ID_BITS)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of the ids that the bitmap lets through, by their own class: rows of one id may have several."""
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            found = batch.filter(pa.array(_in(bitmap, batch.column("hid").to_numpy().view(np.uint64)))).column("text")
            for part in slices(iter([pa.RecordBatch.from_arrays([found], names=["text"])])):
                c = [class_of(shingle_set(x, k)) for x in as_bytes(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), part.column(0)], names=["c", "text"])

    texts = docs.select("text", F.xxhash64("id").alias("hid")).mapInArrow(only, "c long, text string").groupBy("c").agg(F.first("text").alias("text"))
    left = texts.select(F.col("c").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("c").alias("b"), F.col("text").alias("tb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, np.ndarray] = {}
        for part in slices(batches, 256):
            keep = []
            for ta, tb in zip(as_bytes(part.column("ta")), as_bytes(part.column("tb")), strict=True):
                if len(last) > 200:
                    last.clear()
                for t in (ta, tb):
                    if t not in last:
                        last[t] = shingle_set(t, k)
                x, y = last[ta], last[tb]
                overlap = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * overlap >= percent * (len(x) + len(y) - overlap))
            yield pa.RecordBatch.from_arrays([part.column("la"), part.column("lb")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = written(pairs.select("a", "b", "la", "lb").join(left, "a").join(right, "b").select("la", "lb", "ta", "tb").mapInArrow(verify, "a long, b long"), "links")
    sent.destroy()
    return found


def _sizes_fit(percent: int) -> Column:
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))


def _shares_enough(percent: int) -> Column:
    """Whether `shared` common prefix shingles, and all beyond the prefixes, can make up the overlap needed.

    Up to the smaller of both prefixes' last shingles every common one is counted; of the rest there is at most what one of the sets has beyond its prefix.
    """
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    beyond = lambda n: F.ceil(percent * F.col(n) / 100) - 1
    return F.col("shared") >= need - F.greatest(beyond("na"), beyond("nb"))


def _small(h: np.ndarray, n: np.ndarray, label: np.ndarray, v: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of whole buckets that fill one leaf each, all buckets of a size at once."""
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(h)))
    out = [np.zeros((2, 0), int)]
    for m in np.unique(sizes[sizes > 1]):
        at = starts[sizes == m][:, None]
        i, j = np.triu_indices(m, 1)
        a, b = (at + i).ravel(), (at + j).ravel()
        fit = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[fit], b[fit]
        for k in range(0, len(a), 1 << 16):
            x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            keep = _reaches(v[x], v[y], n[x], n[y], percent)
            out.append(np.stack([x[keep], y[keep]]))
    return tuple(np.concatenate(out, axis=1))


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, la, lb, ha, hb, na, nb, shared): pairs of different components that the trees of their buckets let through, and how many buckets they share.

    rows: (h, c, n, counts, label, hid, hs), hs being all buckets of a class that is in KNOWN of them at most, else empty. Whether the tree lets a pair
    through depends on the pair alone. Of two classes with hs, the first bucket that both are in passes the pair on, with the number of those they
    share; of others each shared bucket does, and the rows are counted, in their tasks first.
    """
    size = rows.groupBy("h").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.join(size.select("h", "m", blocks.alias("blocks")), "h").withColumn("own", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    # Each class goes to the tasks of all pairs of blocks with its own.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    names = ["h", "i", "j", "m", "own", "c", "n", "label", "hid", "counts", "hs"]
    out = ["a", "b", "la", "lb", "ha", "hb", "na", "nb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def add(table: pa.Table, a: np.ndarray, b: np.ndarray) -> None:
            if not len(a):
                return
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            sets = list(map(frozenset, table.column("hs").take(pa.array(used)).to_pylist()))
            keep, times = np.ones(len(a), bool), np.ones(len(a), np.int64)
            for k, (x, y, h) in enumerate(zip(place[: len(a)].tolist(), place[len(a) :].tolist(), table.column("h").to_numpy()[a].tolist(), strict=True)):
                if sets[x] and sets[y]:
                    common = sets[x] & sets[y]
                    keep[k], times[k] = min(common) == h, len(common)
            a, b, times = a[keep], b[keep], times[keep]
            c = table.column("c").to_numpy()
            swap = c[a] > c[b]
            ends = np.where(swap, b, a), np.where(swap, a, b)
            found.append(np.stack([*(table.column(x).to_numpy()[e] for x in ("c", "label", "hid", "n") for e in ends), times]))

        def summed() -> pa.RecordBatch:
            """What was found, each pair once, with the number of buckets."""
            every = np.concatenate([np.zeros((len(out) + 1, 0), np.int64), *found], axis=1)
            found.clear()
            every = every[:, np.lexsort((every[1], every[0]))]
            new = np.flatnonzero(np.concatenate([[True], (every[:2, 1:] != every[:2, :-1]).any(0)])) if every.shape[1] else np.zeros(0, int)
            times = np.add.reduceat(every[-1], new) if len(new) else every[-1]
            return pa.RecordBatch.from_arrays([*(pa.array(x[new], pa.int64()) for x in every[:-1]), pa.array(times, pa.int64())], names=[*out, "times"])

        def columns(table: pa.Table) -> tuple:
            return tuple(table.column(x).to_numpy() for x in ("h", "c", "n", "label", "own")) + (np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(-1, GROUPS),)

        def tree(table: pa.Table) -> None:
            _, c, n, label, own, v = columns(table)
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            a, b = tree_join(Tree(n[left], v[left]), Tree(n[right], v[right]), percent)
            a, b = left[a], right[b]
            keep = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            if i == j:
                keep &= c[a] < c[b]
            add(table, a[keep], b[keep])

        def groups(table: pa.Table) -> None:
            """Whole groups of (h, i, j): small buckets together, larger ones by their trees."""
            m = table.column("m").to_numpy()
            low = table.filter(pa.array(m <= Tree.LEAF))
            if low.num_rows:
                h, _, n, label, _, v = columns(low)
                add(low, *_small(h, n, label, v, percent))
            high = table.filter(pa.array(m > Tree.LEAF))
            if high.num_rows:
                keys = np.stack([high.column(x).to_numpy() for x in ("h", "i", "j")], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    tree(high.slice(s, e - s))

        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            keys = np.stack([table.column(x).to_numpy() for x in ("h", "i", "j")], axis=1)
            cut = int(np.flatnonzero((keys != keys[-1]).any(1))[-1] + 1) if (keys != keys[-1]).any() else 0
            if held and cut == 0 and tuple(keys[0]) == tuple(held[-1].column(x)[-1].as_py() for x in ("h", "i", "j")):
                held.append(table)
                continue
            groups(pa.concat_tables([*held, table.slice(0, cut)]))
            if sum(x.shape[1] for x in found) > 500_000:
                yield summed()
            held = [table.slice(cut)]
        if held:
            groups(pa.concat_tables(held))
        yield summed()

    found = rows.select(names).repartition(F.col("h"), F.col("i"), F.col("j")).sortWithinPartitions("h", "i", "j").mapInArrow(run, ", ".join(f"{x} long" for x in [*out, "times"]))
    return found.groupBy("a", "b").agg(*(F.first(x).alias(x) for x in out[2:]), F.sum("times").alias("shared"))


def _relabelled(label: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(c, label) once the components that `edges` join are one; `label` has all classes that were linked before."""
    new = components(edges)
    if label is None:
        out = written(new.select(F.col("node").alias("c"), F.col("component").alias("label")), "labels")
        discard(new, edges)
        return out
    known = label.join(new, F.col("label") == F.col("node"), "left").select("c", F.coalesce("component", "label").alias("label"))
    # A class that was alone until now is its own component's name.
    alone = new.join(label.select("c"), F.col("node") == F.col("c"), "left_anti").select(F.col("node").alias("c"), F.col("component").alias("label"))
    out = written(known.unionByName(alone), "labels")
    discard(new, edges, label)
    return out


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, first) of each row of `docs`.

    key is `text_key` of the text; first tells the rows that stand for their component, those of the smallest id (and key), and rows
    without words, which stand for themselves.
    """
    own = F.col(id_col).cast("long")
    own = F.struct(own.isNull().alias("unknown"), F.coalesce(own, F.lit(0)).alias("no"), text_key(text_col).alias("key"))  # unknown ids sort last
    docs = docs.select(own.alias("id"), F.col(text_col).alias("text"))
    often = bitmap_of(_often(docs, k), "h")
    sets = written(_sets(docs, k, percent, often), "sets")
    often.destroy()
    classes = sets.where("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.min("id").alias("id"), F.first("first").alias("first"), F.first("counts").alias("counts"))
    classes = written(classes.withColumn("hid", F.xxhash64("id")), "classes")

    live = bitmap_of(_rows(classes).groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h"), "h")
    rows = written(_rows(classes, live), "rows")
    live.destroy()

    def marked() -> DataFrame:
        return rows.withColumn("label", F.col("c")) if label is None else rows.join(label, "c", "left").withColumn("label", F.coalesce("label", "c"))

    label = tried = None
    rounds: list[DataFrame] = []
    for turn in range(ROUNDS):
        # Any choice of pairs will do here, as the last round takes all others whose components still differ.
        now = marked()
        chance = F.struct(F.xxhash64("c", F.pmod("h", F.lit(PIVOTS)), F.lit(turn)), "c")
        pivots = now.groupBy("h").agg(F.min_by(F.struct("c", "n", "label"), chance).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        pairs = now.join(pivots.select("h", "p"), "h").where(F.col("label") != F.col("p.label"))
        first = F.col("c") < F.col("p.c")
        ends = [(F.when(first, F.col(x)).otherwise(F.col(f"p.{x}")), F.when(first, F.col(f"p.{x}")).otherwise(F.col(x))) for x in ("c", "n", "label")]
        pairs = pairs.select(*(e.alias(name) for pair, both in zip(ends, (("a", "b"), ("na", "nb"), ("la", "lb")), strict=True) for e, name in zip(pair, both, strict=True))).where(_sizes_fit(percent))
        pairs = pairs.groupBy("a", "b").agg(*(F.first(x).alias(x) for x in ("na", "nb", "la", "lb")), (2 * PIVOTS * F.count("*")).alias("shared")).where(_shares_enough(percent))
        new = written(_bounded(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), classes, percent), "tried")
        found = _verified(new, docs, k, percent)
        rounds.append(new)
        tried = new.select("a", "b") if tried is None else tried.unionByName(new.select("a", "b"))
        if found.limit(1).count() == 0:
            break
        label = _relabelled(label, found)

    now = marked()
    mixed = now.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
    now = now.join(mixed, "h").groupBy("c").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.sort_array(F.collect_list("h")).alias("own")).join(classes.select("c", "counts", "hid"), "c")
    now = now.select("c", "n", "label", "counts", "hid", F.when(F.size("own") <= KNOWN, F.col("own")).otherwise(F.array().cast("array<long>")).alias("hs"), F.explode("own").alias("h"))
    rest = written(_joined(now, percent).where(_shares_enough(percent)).select("a", "b", "la", "lb", "ha", "hb").join(tried, ["a", "b"], "left_anti"), "rest")
    label = _relabelled(label, _verified(rest, docs, k, percent))
    discard(rows, rest, *rounds)

    named = classes.select("c", "id").join(label, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.groupBy("label").agg(F.min("id").alias("least"))
    named = named.join(least, "label").select("c", "least")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    known = lambda x: F.when(~x["unknown"], x["no"])
    found = sets.select("id", "n", "c").join(named, "c", "left")
    return found.select(known(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(component).alias("component_id"), F.col("id.key").alias("key"), (F.col("id") == component).alias("first"))
