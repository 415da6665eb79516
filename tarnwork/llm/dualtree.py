"""Exact top-k search by inner product for many queries at once, with cover trees over queries and data.

All rows, queries among them, are dealt to cells around pivots (the top of the tree: chosen farthest-first among a sample of at most `SAMPLE` rows, the
only thing that a sample decides), each cell to blocks of about `BLOCK` rows, and each block's rows to a cover tree; the queries of each cell, in groups of
about `GROUP`, to cover trees of their own under the same pivots. A tree's node has the point at its centre, among its children's centres, and the largest distance of its
points from it; children's centres lie apart by their covering distance at least. Searches descend both trees: a pair of nodes goes on while the best
score that their centres, radii and norms allow is not below the worst kth score among the queries of the one. The search of a group's own block
comes first, so that every other one begins with thresholds. Pairs of cells are pruned in the same way before groups travel to blocks.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as filled up with zeros; components
are floor(scale * x), and scores whole numbers, exact up to 64 bits, beyond which it is an error. A query's own row is no candidate, another row of its id
is. Ties go to the smaller id, null ids last, and then it doesn't matter which row. A row of a null id is no query. With fewer than k candidates all
are returned. Each of several query rows of one id has its own results. Without vectors or queries the result is empty. Other columns of the table,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import discard, written

SAMPLE = 4096
BLOCK = 2048
GROUP = 1024
CELLS = 1024
#: Points of a leaf, children of a node, data leaves compared at once.
LEAF, FAN, ABREAST = 32, 8, 16
NO_ID = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min
POINT = "row long, vec_id long, is_query boolean, cell int, far double, norm double, vec binary"
TREE = "cell int, salt int, rows binary, ids binary, points binary, nodes binary, worst long, best binary"


@dataclass
class Tree:
    """Points in an order in which each node's are consecutive. nodes: (begin, end, centre, first child, children) by breadth, with radius and largest norm."""

    rows: np.ndarray
    ids: np.ndarray
    points: np.ndarray
    nodes: np.ndarray
    radius: np.ndarray
    norm: np.ndarray


def farthest_first(x: np.ndarray, first: int, most: int, until: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(centres, each point's nearest centre, its distance): the farthest point becomes a centre until all lie within `until` or there are `most`."""
    centres, near, far = [first], np.zeros(len(x), np.int64), np.sqrt(((x - x[first]) ** 2).sum(1))
    while len(centres) < most:
        at = int(far.argmax())
        if far[at] <= until:
            break
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        near[d < far] = len(centres)
        far = np.minimum(far, d)
        centres.append(at)
    return centres, near, far


def build(rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> Tree:
    x = points.astype(np.float64)
    norms = np.sqrt((x * x).sum(1))
    order, todo, nodes, radius = np.arange(len(x)), [], [], []

    def add(begin: int, end: int, centre: int) -> None:
        nodes.append([begin, end, centre, 0, 0])
        radius.append(float(np.sqrt(((x[order[begin:end]] - x[centre]) ** 2).sum(1)).max()))
        todo.append(len(nodes) - 1)

    add(0, len(x), int(((x - x.mean(0)) ** 2).sum(1).argmin()))
    for k in todo:  # grows meanwhile
        begin, end, centre = nodes[k][:3]
        if end - begin <= LEAF or radius[k] == 0:
            continue
        own = order[begin:end].copy()
        centres, near, _ = farthest_first(x[own], int(np.flatnonzero(own == centre)[0]), FAN, radius[k] / 2)
        by = np.argsort(near, kind="stable")
        order[begin:end] = own[by]
        sizes = np.bincount(near, minlength=len(centres))
        nodes[k][3:] = [len(nodes), len(centres)]
        for c, size in zip(centres, sizes, strict=True):
            add(begin, begin + int(size), int(own[c]))
            begin += int(size)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    table = np.array(nodes, np.int64).reshape(-1, 5)
    table[:, 2] = place[table[:, 2]]
    return Tree(rows[order], ids[order], points[order], table, np.array(radius), np.array([norms[order[b:e]].max() for b, e in table[:, :2]]))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors as whole numbers: by floats where these are exact, else by integers, else by Python's."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest < 1 << 63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # an error beyond 64 bits


def allowed(q: np.ndarray, q_far: np.ndarray, q_norm: np.ndarray, d: np.ndarray, d_far: np.ndarray, d_norm: np.ndarray, dots: np.ndarray) -> np.ndarray:
    """The largest inner product that points within q_far of q and d_far of d, of at most these norms, can have; a little more, for rounding.

    With what is between them: the centres' product and radii; the norms; the distance, as 2 qd = |q|^2 + |d|^2 - |q - d|^2.
    """
    q_len, d_len = np.sqrt((q * q).sum(-1)), np.sqrt((d * d).sum(-1))
    apart = np.sqrt(np.maximum(0, q_len**2 + d_len**2 - 2 * dots))
    by_centres = dots + q_far * d_len + d_far * q_len + q_far * d_far
    by_distance = (q_norm**2 + d_norm**2 - np.maximum(0, apart - q_far - d_far) ** 2) / 2
    return np.minimum(np.minimum(by_centres, q_norm * d_norm), by_distance) + 1e-6 * (1 + (q_norm + q_far) * (d_norm + d_far))


class Best:
    """The k best candidates of each query so far: scores, ids and rows, best first."""

    def __init__(self, n: int, k: int):
        self.score, self.ids, self.rows = np.full((n, k), NONE), np.full((n, k), NO_ID), np.full((n, k), -1)

    def add(self, begin: int, end: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own, k = slice(begin, end), self.score.shape[1]
        some = np.flatnonzero((score >= self.score[own, -1:]).any(0))
        if not len(some):
            return
        score = np.concatenate([self.score[own], score[:, some]], 1)
        wide = (end - begin, len(some))
        ids = np.concatenate([self.ids[own], np.broadcast_to(ids[some], wide)], 1)
        rows = np.concatenate([self.rows[own], np.broadcast_to(rows[some], wide)], 1)
        first = np.lexsort((ids, ~score), axis=1)[:, :k]  # ~ turns the order of all 64-bit numbers round
        self.score[own], self.ids[own], self.rows[own] = (np.take_along_axis(a, first, 1) for a in (score, ids, rows))


def search(queries: Tree, data: Tree, k: int, floor: np.ndarray | None = None) -> Best:
    """Each query's k best of the data but its own row, of those not below its `floor`."""
    best = Best(len(queries.rows), k)
    floor = np.full(len(queries.rows), NONE) if floor is None else floor
    worst = np.array([floor[b:e].min() for b, e in queries.nodes[:, :2]])
    q_at, d_at = queries.points[queries.nodes[:, 2]].astype(np.float64), data.points[data.nodes[:, 2]].astype(np.float64)
    a, b, leaves = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(a):
        q, d = q_at[a], d_at[b]
        bound = allowed(q, queries.radius[a], queries.norm[a], d, data.radius[b], data.norm[b], (q * d).sum(1))
        on = bound >= worst[a]
        a, b, bound = a[on], b[on], bound[on]
        n_q, n_d = queries.nodes[a, 4], data.nodes[b, 4]
        ends = (n_q == 0) & (n_d == 0)
        leaves.append((a[ends], b[ends], bound[ends]))
        down = ~ends & ((n_q == 0) | (n_d > 0) & (data.radius[b] >= queries.radius[a]))
        up = ~ends & ~down
        next_a = [np.repeat(a[down], n_d[down]), _children(queries.nodes, a[up])]
        next_b = [_children(data.nodes, b[down]), np.repeat(b[up], n_q[up])]
        a, b = np.concatenate(next_a), np.concatenate(next_b)
    a, b, bound = (np.concatenate(x) for x in zip(*leaves, strict=True))
    for leaf in np.unique(a):
        begin, end = queries.nodes[leaf, :2]
        mine = np.flatnonzero(a == leaf)
        mine = mine[np.argsort(-bound[mine], kind="stable")]
        for at in range(0, len(mine), ABREAST):
            some = mine[at : at + ABREAST]
            least = np.maximum(best.score[begin:end, -1], floor[begin:end])
            some = some[bound[some] >= least.min()]
            if not len(some):
                break  # the bounds that follow are lower still
            points = np.concatenate([np.arange(*data.nodes[j, :2]) for j in b[some]])
            score = exact_products(queries.points[begin:end], data.points[points])
            score[(queries.rows[begin:end, None] == data.rows[points]) | (score < floor[begin:end, None])] = NONE
            best.add(begin, end, score, data.ids[points], data.rows[points])
    return best


def _children(nodes: np.ndarray, of: np.ndarray) -> np.ndarray:
    n = nodes[of, 4]
    return np.repeat(nodes[of, 3], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _vectors(column: pa.Array | pa.ChunkedArray, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that take part, their vectors of whole numbers)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    values = pc.fill_null(pc.list_flatten(column).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    fine = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    fine[of[~np.isfinite(values)]] = False
    keep = fine[of]
    x = np.floor(scale * values[keep])
    if np.abs(x).max(initial=0) >= 1 << 62:
        raise ValueError("a component is beyond 62 bits")
    out = np.zeros((len(sizes), width), np.int64)
    out[of[keep], (np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[keep]] = x
    at = np.flatnonzero(fine)
    return at, out[at]


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _to_row(cell: int, salt: int, tree: Tree, worst: int = 0, best: bytes = b"") -> pa.RecordBatch:
    nodes = np.concatenate([tree.nodes.astype(np.float64), tree.radius[:, None], tree.norm[:, None]], 1)
    values = [cell, salt, _packed(tree.rows), _packed(tree.ids), _packed(tree.points), _packed(nodes), worst, best]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["cell", "salt", "rows", "ids", "points", "nodes", "worst", "best"])


def _from_row(r: dict, end: str = "") -> Tree:
    rows, ids = (np.frombuffer(r[c + end], np.int64) for c in ("rows", "ids"))
    nodes = np.frombuffer(r["nodes" + end], np.float64).reshape(-1, 7)
    return Tree(rows, ids, np.frombuffer(r["points" + end], np.int64).reshape(len(rows), -1), nodes[:, :5].astype(np.int64), nodes[:, 5], nodes[:, 6])


def _grown(points: DataFrame, key: str) -> DataFrame:
    """A row with the tree of each (cell, salt)."""

    def grow(at: tuple, table: pa.Table) -> pa.Table:
        rows, ids = table["row"].to_numpy(), table["vec_id"].to_numpy()
        vectors = np.frombuffer(b"".join(table["vec"].to_pylist()), np.int64).reshape(len(rows), -1)
        order = np.argsort(rows)  # rows come in any order
        return pa.Table.from_batches([_to_row(at[0].as_py(), at[1].as_py(), build(rows[order], ids[order], vectors[order]))])

    return points.groupBy("cell", key).applyInArrow(grow, TREE)


def _salted(points: DataFrame, most: int, n: dict[int, int]) -> DataFrame:
    """Cells of more rows are dealt to several blocks by a hash of the row."""
    several = {c: -(-m // most) for c, m in n.items()}
    if not several:
        return points.withColumn("salt", F.lit(0))
    blocks = F.create_map(*(F.lit(int(x)) for pair in several.items() for x in pair))[F.col("cell")]
    return points.withColumn("salt", F.pmod(F.xxhash64("row"), blocks.cast("long")).cast("int"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query row's k best other rows."""
    spark = vectors.sparkSession
    # A query is one by what it is, so the mark is made of the table's own columns.
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    known = raw.where("embedding is not null")
    n_all, width = known.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    sample = known.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE).select("embedding").toArrow()["embedding"]
    tried = _vectors(sample, width, scale)[1].astype(np.float64) if len(sample) else np.zeros((0, width))
    centres = farthest_first(tried, 0, min(CELLS, -(-n_all // BLOCK)))[0] if len(tried) else []
    pivots = tried[centres] if centres else np.zeros((1, width))
    half = (pivots**2).sum(1) / 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fine, x = _vectors(part.column("embedding"), width, scale)
                f = x.astype(np.float64)
                cell = (f @ pivots.T - half).argmax(1) if len(fine) else np.zeros(0, np.int64)
                far = np.sqrt(((f - pivots[cell]) ** 2).sum(1))
                rest = part.select(["row", "vec_id", "is_query"]).take(pa.array(fine))
                ids = pc.fill_null(rest.column("vec_id"), int(NO_ID))
                query = pc.and_(rest.column("is_query"), pc.is_valid(rest.column("vec_id")))
                yield pa.RecordBatch.from_arrays([rest.column("row"), ids, query, pa.array(cell, pa.int32()), pa.array(far), pa.array(np.sqrt((f * f).sum(1))), pa.array([_packed(v) for v in x], pa.binary())], names=["row", "vec_id", "is_query", "cell", "far", "norm", "vec"])

    points = written(raw.withColumn("row", F.monotonically_increasing_id()).mapInArrow(place, POINT), "points")
    cells = points.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("is_query").alias("n_query"), *(F.max(c).alias(c) for c in ("far", "norm")), *(F.max(F.when(F.col("is_query"), F.col(c))).alias(f"q_{c}") for c in ("far", "norm"))).collect()
    blocks = written(_grown(_salted(points, BLOCK, {r.cell: r.n for r in cells}), "salt"), "blocks")
    groups = _grown(_salted(points.where("is_query"), GROUP, {r.cell: r.n_query for r in cells if r.n_query}), "salt")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The group with its queries' kth scores in one block of its own cell, and the worst of these."""
        for batch in batches:
            for j in range(batch.num_rows):
                r = {c: batch.column(c)[j].as_py() for c in batch.schema.names}
                group = _from_row(r)
                kth = search(group, _from_row(r, "_d"), k).score[:, -1]
                yield _to_row(r["cell"], r["salt"], group, int(kth.min()), _packed(kth))

    data = blocks.select("cell", F.col("salt").alias("block"), *(F.col(c).alias(f"{c}_d") for c in ("rows", "ids", "points", "nodes")))
    own = data.where("block = 0").drop("block")
    groups = written(groups.join(own, "cell").mapInArrow(first, TREE), "groups")
    discard(points)
    worst = {r.cell: r.worst for r in groups.groupBy("cell").agg(F.min("worst").alias("worst")).collect()}
    some = [r for r in cells if r.cell in worst]
    pairs = []
    if some:
        at, to = np.array([r.cell for r in some]), np.array([r.cell for r in cells])
        q, d = pivots[at], pivots[to]
        column = lambda rows, c: np.array([getattr(r, c) for r in rows], np.float64)
        bound = allowed(q[:, None], column(some, "q_far")[:, None], column(some, "q_norm")[:, None], d[None], column(cells, "far")[None], column(cells, "norm")[None], q @ d.T)
        several = {r.cell: -(-r.n // BLOCK) for r in cells}
        on = bound >= np.array([worst[c] for c in at], np.float64)[:, None]
        pairs = [(int(at[i]), int(to[j]), several[int(to[j])]) for i, j in zip(*np.nonzero(on), strict=True)]
    # At most CELLS x CELLS pairs of cells; each group goes once to each block of the cells that it may find something in.
    reach = spark.createDataFrame(pairs, "cell int, to int, n int")
    sent = groups.join(reach, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("to", "block", "rows", "ids", "points", "nodes", "worst", "best")
    heads = blocks.select(F.col("cell").alias("to"), F.col("salt").alias("block"), *(F.col(c).alias(f"{c}_d") for c in ("rows", "ids", "points", "nodes")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                r = {c: batch.column(c)[j].as_py() for c in batch.schema.names}
                group = _from_row(r)
                best = search(group, _from_row(r, "_d"), k, np.frombuffer(r["best"], np.int64))
                i, c = np.nonzero(best.score > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group.rows[i], group.ids[i], best.ids[i, c], best.score[i, c])], names=["row", "query_id", "vec_id", "score"])

    found = sent.join(heads, ["to", "block"]).drop("to", "block").mapInArrow(meet, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != int(NO_ID), F.col("vec_id")).alias("vec_id"), "score")
