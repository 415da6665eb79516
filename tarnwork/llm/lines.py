"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes if an earlier line (by document id, then text, then line number) is within `max_edits` edits of it; of equal
lines the first stays. Two lines that close share one of the `max_edits` + 1 segments into which the shorter is cut, at
nearly the same place: each line is looked up under its own segments, and under those of its substrings that can be a segment of a line of
its length or up to `max_edits` less, as far as the place allows (the multi-match rule). Lines are told apart by two 64-bit hashes. Keys that only one line has are dropped by
an aggregation over hashes; only lines with a shared key carry their text on. Pairs are verified by a banded
bit-parallel edit distance: the band of 2 * max_edits + 1 cells of a column is one integer.

To bear families of alike lines, each line is first compared with the earliest line of its keys; only lines that stay, and only against
earlier lines, are joined in full. The keys are small hashes; where those that are shared are few they are broadcast, else joined by shuffle.

Defined results: lines of fewer than `min_chars` characters always stay; a null or empty text stays as it is; null ids come first;
rows of the same id and text are one document and keep the same lines; other columns pass through, but for columns named _n_lines or _n_removed,
which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import discard, text_key, unused, written

#: Shared keys that may be broadcast (8 bytes each); with more, the join is a shuffle.
FEW = 2_000_000
#: Blocks, and letters whose numbers of occurrences, that tell lines apart before they are compared.
BLOCKS = 16
LETTERS = "abcdefghijklmnopqrstuvwxyz .,"


def distance_within(a: Column, b: Column, most: int) -> Column:
    """Whether strings a and b, a at least as long as b by at most `most`, are within `most` edits.

    Bit t of an integer stands for row j - most + t of column j; vertical differences of the column before are vp (+1) and vn (-1).
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    xs, ys = F.regexp_extract_all(a, F.lit("(?s)."), F.lit(0)), F.regexp_extract_all(b, F.lit("(?s)."), F.lit(0))
    long = lambda x: F.lit(x).cast("long")

    def negated(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(long(full))

    def column(s: Column, acc: Column, j: Column) -> Column:
        y = F.get(s["ys"], j - 1)
        bits = [F.when(F.get(s["xs"], j - 1 - most + t) == y, long(1 << t)).otherwise(long(0)) for t in range(width)]
        pm = reduce(lambda p, q: p.bitwiseOR(q), bits)
        return F.transform(F.array(pm), lambda pm: _advance(acc, pm, negated, s["d"], most, full))[0]

    start = F.struct(long(full & ~((1 << most) - 1)).alias("vp"), long(0).alias("vn"), (F.char_length(a) - F.char_length(b)).cast("int").alias("score"))
    inputs = F.struct(xs.alias("xs"), ys.alias("ys"), (F.char_length(a) - F.char_length(b)).cast("int").alias("d"))
    steps = F.when(F.char_length(b) > 0, F.sequence(F.lit(1), F.char_length(b))).otherwise(F.array().cast("array<int>"))
    result = F.transform(F.array(inputs), lambda s: F.aggregate(steps, start, lambda acc, j: column(s, acc, j), lambda acc: acc["score"]))[0]
    return result <= most


def _advance(acc: Column, pm: Column, negated, d: Column, most: int, full: int) -> Column:  # noqa: ANN001
    vp, vn = acc["vp"], acc["vn"]
    mask = F.lit(full).cast("long")
    d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(mask)

    def rest(d0: Column) -> Column:
        hp = vn.bitwiseOR(negated(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        x = F.shiftright(d0, 1)
        bit = F.try_element_at(F.array(*(F.shiftright(d0, most + t).bitwiseAND(F.lit(1).cast("long")) for t in range(most + 1))), d + 1)
        return F.struct(hn.bitwiseOR(negated(x.bitwiseOR(hp))).alias("vp"), x.bitwiseAND(hp).alias("vn"), (acc["score"] + 1 - bit.cast("int")).alias("score"))

    return F.transform(F.array(d0), rest)[0]


def _keyed(rows: DataFrame, most: int, min_chars: int) -> DataFrame:
    """(h, key, own, line) of (h, line): hashes of the line's substrings as segments of lines of its length and less; own if also its own segment."""
    parts = most + 1
    probes = [(less, i, shift) for less in range(most + 1) for i in range(1, parts + 1) for shift in range(max(-(i - 1), less - (parts - i)), min(i - 1, less + (parts - i)) + 1)]
    plan = F.array(*(F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in probes))
    rows = rows.withColumn("length", F.char_length("line")).withColumn("p", F.explode(plan)).select("h", "line", "length", "p.*")
    target = F.col("length") - F.col("less")
    size, longer = F.floor(target / parts).cast("int"), target % parts
    place = F.lit(1) + size * (F.col("i") - 1) + F.greatest(F.lit(0), longer - (parts - F.col("i") + 1))  # the last `longer` segments have one more
    chars = size + F.when(F.col("i") > F.lit(parts) - longer, 1).otherwise(0)
    rows = rows.select("h", "line", "length", "less", "i", "shift", target.alias("target"), (place + F.col("shift")).alias("begin"), chars.alias("chars"))
    rows = rows.where((F.col("target") >= min_chars) & (F.col("begin") >= 1) & (F.col("begin") + F.col("chars") - 1 <= F.col("length")))
    key = F.xxhash64("i", "target", F.col("line").substr(F.col("begin"), F.col("chars")))
    return rows.select("h", key.alias("key"), ((F.col("less") == 0) & (F.col("shift") == 0)).alias("own"), "line")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2, min_chars: int = 20) -> DataFrame:
    """`docs` with the text's later near-equal lines removed, and _n_lines and _n_removed beside it."""
    at = F.posexplode(F.split(F.col("text"), "\n", -1)).alias("no", "line")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tk"), F.col(text_col).alias("text")).select("doc_id", "tk", at)
    rows = rows.where(F.char_length("line") >= min_chars)
    place = F.struct("doc_id", "tk", "no")
    hashed = F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")
    first = written(rows.select(place.alias("place"), *hashed).groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("n")), "line-first")

    keyed = _keyed(rows.select(F.xxhash64("line").alias("h"), "line"), max_edits, min_chars)
    shared = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("own")).where("lo <> hi and own").select("key")
    shared = written(shared, "line-keys")
    live = keyed.join(F.broadcast(shared) if shared.count() <= FEW else shared, "key").withColumn("g", hashed[1])
    live = live.groupBy("key", "h", "g").agg(F.max("own").alias("own"), F.first("line").alias("line")).join(first.select("h", "g", "first"), ["h", "g"])
    table = written(live.select("key", "h", "g", "own", "line", "first", _parities(F.col("line")).alias("odd")), "line-live")
    texts = table.groupBy("h", "g").agg(F.first("line").alias("line"))
    live = table.drop("line")
    alike = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= 2 * max_edits
    differ = lambda a, b: (F.col(a[0]) != F.col(b[0])) | (F.col(a[1]) != F.col(b[1]))

    pivots = live.groupBy("key").agg(F.min_by(F.struct("h", "g", "own", "first", "odd"), "first").alias("p"))
    pairs = live.join(pivots, "key").where(differ(("h", "g"), ("p.h", "p.g")) & (F.col("own") | F.col("p.own")) & alike("odd", "p.odd"))
    early = written(_near(pairs.select("h", "g", F.col("p.h").alias("eh"), F.col("p.g").alias("eg")), texts, max_edits), "line-gone-1")

    left = live.join(early, ["h", "g"], "left_anti").join(pivots.select("key", F.col("p.h").alias("eh"), F.col("p.g").alias("eg")), "key").where(differ(("h", "g"), ("eh", "eg")))
    other = live.select(*(F.col(c).alias(f"o_{c}") for c in ("key", "h", "g", "own", "first", "odd")))
    test = (F.col("key") == F.col("o_key")) & (F.col("o_first") < F.col("first")) & differ(("o_h", "o_g"), ("eh", "eg")) & (F.col("own") | F.col("o_own")) & alike("odd", "o_odd")
    pairs = left.join(other, test)
    gone = written(early.unionByName(_near(pairs.select("h", "g", F.col("o_h").alias("eh"), F.col("o_g").alias("eg")), texts, max_edits)).distinct(), "line-gone")

    discard(shared, table, early)
    # Of lines that occur once and stay, nothing more is needed.
    fate = first.join(gone.withColumn("gone", F.lit(True)), ["h", "g"], "left").where("n > 1 or gone")
    drop = rows.select("doc_id", "tk", "no", place.alias("place"), *hashed).join(fate, ["h", "g"]).where((F.col("place") != F.col("first")) | F.coalesce("gone", F.lit(False)))
    own, key, lost, there = (unused(docs, c) for c in ("_id", "_key", "_lost", "_there"))  # names that no column of `docs` has
    drop = drop.groupBy(F.col("doc_id").alias(own), F.col("tk").alias(there)).agg(F.collect_set("no").alias(lost))
    marked = docs.withColumn(key, text_key(text_col)).join(drop, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(key) == F.col(there)), "left")
    split = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(lost, i)), "\n")
    return marked.select(
        *(F.when(F.col(lost).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("_n_lines", "_n_removed")),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("_n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("_n_removed"),
    )


def _parities(line: Column) -> Column:
    """Bits that tell which letters occur an odd number of times: an edit changes two of them at most."""
    bits = [F.pmod(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(2)).cast("long") * F.lit(1 << k) for k, c in enumerate(LETTERS)]
    return reduce(lambda p, q: p + q, bits)


def _near(pairs: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(h, g) of the lines that are within the distance of an earlier one. pairs: (h, g, eh, eg); texts: (h, g, line)."""
    pairs = pairs.distinct().join(texts, ["h", "g"]).join(texts.select(F.col("h").alias("eh"), F.col("g").alias("eg"), F.col("line").alias("earlier")), ["eh", "eg"])
    size, other = F.char_length("line"), F.char_length("earlier")
    pairs = pairs.where(F.abs(size - other) <= most)
    pairs = pairs.select("h", "g", "eh", "eg", F.when(size >= other, F.struct(F.col("line").alias("a"), F.col("earlier").alias("b"))).otherwise(F.struct(F.col("earlier").alias("a"), F.col("line").alias("b"))).alias("p"))
    # Verification is the costly part: spread it evenly, over a number of tasks that Spark doesn't take back.
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h", "g", "eh", "eg").select("h", "g", "p.a", "p.b")
    count = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    letters = F.array(*map(F.lit, LETTERS))
    moved = F.aggregate(letters, F.lit(0), lambda n, c: n + F.abs(count(F.col("a"), c) - count(F.col("b"), c)))  # an edit moves two counts by one at most
    pairs = pairs.where(moved <= 2 * most)
    # Of the shorter line's blocks, an edit damages one at most; the others are in the longer one, at nearly their place.
    part = lambda j, n: F.floor(F.char_length("b") * j / n).cast("int")
    steps = lambda n: F.array(*map(F.lit, range(1, n + 1)))
    block = lambda j: F.substring(F.col("b"), part(j - 1, BLOCKS) + 1, part(j, BLOCKS) - part(j - 1, BLOCKS))
    around = lambda j: F.substring(F.col("a"), F.greatest(part(j - 1, BLOCKS) + 1 - most, F.lit(1)), part(j, BLOCKS) - part(j - 1, BLOCKS) + 2 * most)
    pairs = pairs.where(F.size(F.filter(steps(BLOCKS), lambda j: F.contains(around(j), block(j)))) >= BLOCKS - most)
    return pairs.where(distance_within(F.col("a"), F.col("b"), most)).select("h", "g").distinct()
