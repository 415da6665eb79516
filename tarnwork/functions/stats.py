"""Statistics of columns, tests with p-values, and the scalar functions that they need (no SciPy)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.aggregate import average_ranks, geometric_mean, harmonic_mean
from tarnwork.operators.relational import numbered, running

# -- distribution functions ----------------------------------------------------------------


def gammln(x: float) -> float:
    return math.lgamma(x)


def betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + numerator * d, 1 + numerator / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def betai(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * betacf(b, a, 1 - x) / b


def gammq(a: float, x: float) -> float:
    """Upper regularized incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 2000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * front
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for k in range(1, 2000):
        an = -k * (k - a)
        b += 2
        d, c = an * d + b, b + an / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chisqprob(x: float, df: float) -> float:
    return gammq(df / 2, x / 2)


def zprob(z: float) -> float:
    """P(Z <= z)."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def fprob(dfn: float, dfd: float, f: float) -> float:
    return betai(dfd / 2, dfn / 2, dfd / (dfd + dfn * f))


def tprob(t: float, df: float) -> float:
    """Two-sided."""
    return betai(df / 2, 0.5, df / (df + t * t))


# -- combinatorics -----------------------------------------------------------------------------


def comb(n: int, k: int) -> int:
    return math.comb(n, k)


def stirling2(n: int, k: int) -> int:
    return sum((-1) ** (k - j) * math.comb(k, j) * j**n for j in range(k + 1)) // math.factorial(k)


def bell(n: int) -> int:
    return sum(stirling2(n, k) for k in range(n + 1))


def logfact(n: int) -> float:
    return math.lgamma(n + 1)


def logcomb(n: int, k: int) -> float:
    return logfact(n) - logfact(k) - logfact(n - k)


# -- columns ---------------------------------------------------------------------------------------


def central(df: DataFrame, name: str) -> DataFrame:
    x = F.col(name)
    return df.agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.mode(x, deterministic=True).alias("mode"), geometric_mean(x).alias("geometric_mean"), harmonic_mean(x).alias("harmonic_mean"))


def moments(df: DataFrame, name: str) -> DataFrame:
    """Population moments from raw sums of centered values; kurtosis is not in excess, variation is in percent."""
    mean = df.agg(F.avg(name).alias("_m"))
    d = F.col(name) - F.col("_m")
    m = df.join(F.broadcast(mean)).agg(F.first("_m").alias("m"), *(F.avg(F.pow(d, F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)))
    return m.select((100 * F.sqrt("m2") / F.col("m")).alias("variation"), (F.col("m3") / F.pow("m2", F.lit(1.5))).alias("skewness"), (F.col("m4") / (F.col("m2") * F.col("m2"))).alias("kurtosis"))


def variability(df: DataFrame, name: str) -> DataFrame:
    x = F.col(name)
    return df.agg(F.var_pop(x).alias("samplevar"), F.stddev_pop(x).alias("samplestd"), F.var_samp(x).alias("var"), F.stddev_samp(x).alias("std"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sterr"), F.sum(x * x).alias("ss"))


def z_scores(df: DataFrame, name: str, out: str = "z") -> DataFrame:
    fit = df.agg(F.avg(name).alias("_m"), F.stddev_pop(name).alias("_s"))
    return df.join(F.broadcast(fit)).withColumn(out, (F.col(name) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def histogram(df: DataFrame, name: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n, cumulative, relative) of equal bins; values outside are left out."""
    b = F.least(F.floor((F.col(name) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    n = df.where(F.col(name).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(0))
    return n.select("bin", "n", F.sum("n").over(one.orderBy("bin")).alias("cumulative"), (F.col("n") / F.sum("n").over(one)).alias("relative"))


def score_at_percentile(df: DataFrame, name: str, p: float) -> DataFrame:
    """The sorted element at int(n p / 100 + 0.5), from 0; found over distinct values."""
    t = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("x")).agg(F.count("*").alias("n"))
    t = running(t, ["x"], {"upto": "n"}).join(F.broadcast(t.agg(F.sum("n").alias("all"))))
    at = F.least(F.floor(F.col("all") * p / 100 + 0.5), F.col("all") - 1)
    return t.where(F.col("upto") > at).agg(F.min("x").alias("score"))


def percentile_of_score(df: DataFrame, name: str, score: float) -> DataFrame:
    return df.agg((100 * F.count_if(F.col(name) < score) / F.count(name)).alias("percentile"))


def trim_both(df: DataFrame, name: str, share: float, order: Sequence[str]) -> DataFrame:
    """Rows without the share of lowest and of highest values."""
    total = df.agg(F.count("*").alias("_n"))
    cut = F.floor(F.col("_n") * share)
    return numbered(df, [name, *order], "_r").join(F.broadcast(total)).where((F.col("_r") >= cut) & (F.col("_r") < F.col("_n") - cut)).drop("_r", "_n")


def linregress(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.corr(a, b).alias("r"))


def point_biserial(df: DataFrame, binary: str, x: str) -> DataFrame:
    return df.agg(F.corr(F.col(binary).cast("double"), F.col(x).cast("double")).alias("r"))


def kendall(df: DataFrame, a: str, b: str, key: str | None = None) -> DataFrame:
    """Tau over all pairs of rows, without making them.

    Values of `a` get ranks. Two rows of different ranks part at the highest bit in which these differ: there they have the bits above in common, and
    one has a 0, the other a 1. So each row counts once per bit, among the rows of its higher bits, by running totals over `b`: n log n rows in all.
    """
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").cast("double").alias("w"))
    ranks = numbered(known.select("x").distinct(), ["x"], "rank")
    most = ranks.agg(F.max("rank")).first()[0] or 0
    rows = known.join(ranks, "x").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(int(most).bit_length() - 1, 0)))))
    bit = F.expr("shiftright(rank, level) & 1")
    cells = rows.groupBy("level", F.expr("shiftright(shiftright(rank, level), 1)").alias("above"), "y").agg(F.sum(F.when(bit == 0, F.col("w")).otherwise(0.0)).alias("low"), F.sum(F.when(bit == 1, F.col("w")).otherwise(0.0)).alias("high"))
    cells = running(cells, ["y"], {"upto": "low"}, ["level", "above"])
    s = cells.groupBy("level", "above").agg(F.sum(F.col("high") * (2 * F.col("upto") - F.col("low"))).alias("twice"), F.sum("high").alias("h"), F.sum("low").alias("l")).agg(F.sum(F.col("twice") - F.col("h") * F.col("l")).alias("s"))
    n = F.sum("w")
    pairs = lambda c: known.groupBy(c).agg(F.sum("w").alias("w")).agg(((n * n - F.sum(F.col("w") * F.col("w"))) / 2).alias(f"pairs_{c}"))  # noqa: E731  that differ in c
    return s.join(F.broadcast(pairs("x"))).join(F.broadcast(pairs("y"))).select(F.try_divide("s", F.sqrt(F.col("pairs_x") * F.col("pairs_y"))).alias("tau"))


# -- tests -----------------------------------------------------------------------------------------


def ttest_1samp(df: DataFrame, name: str, mean: float) -> DataFrame:
    x = F.col(name)
    return df.agg(((F.avg(x) - mean) / (F.stddev_samp(x) / F.sqrt(F.count(x)))).alias("t"), (F.count(x) - 1).alias("df"))


def ttest_ind(df: DataFrame, name: str, group: Column) -> DataFrame:
    """Student's t of two groups with a pooled variance."""
    a, b = F.when(group, F.col(name)), F.when(~group, F.col(name))
    n1, n2 = F.count(a), F.count(b)
    pooled = ((n1 - 1) * F.var_samp(a) + (n2 - 1) * F.var_samp(b)) / (n1 + n2 - 2)
    return df.agg(((F.avg(a) - F.avg(b)) / F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("t"), (n1 + n2 - 2).alias("df"))


def ttest_rel(df: DataFrame, a: str, b: str) -> DataFrame:
    return ttest_1samp(df.select((F.col(a) - F.col(b)).alias("_d")), "_d", 0.0)


def chisquare(df: DataFrame, name: str) -> DataFrame:
    """Against equal shares of the values there are."""
    t = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").cast("double").alias("n"))
    whole = t.agg(F.avg("n").alias("e"))
    return t.join(F.broadcast(whole)).agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("chi2"), (F.count("*") - 1).alias("df"))


def anova(df: DataFrame, name: str, group: str) -> DataFrame:
    """F of one-way analysis of variance."""
    g = df.where(F.col(name).isNotNull()).groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum(name).alias("s"), F.sum(F.col(name) * F.col(name)).alias("q"))
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    within = F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    k = F.count("*")
    return g.agg(((between / (k - 1)) / (within / (F.sum("n") - k))).alias("f"))


def mann_whitney(df: DataFrame, name: str, group: Column) -> DataFrame:
    """U of the first group, ranks shared by ties."""
    r = average_ranks(df.select(F.col(name).alias("_v"), group.alias("_g")), "_v", "_rank")
    n1 = F.count_if(F.col("_g"))
    return r.agg((F.sum(F.when(F.col("_g"), F.col("_rank"))) - n1 * (n1 + 1) / 2).alias("u"), n1.alias("n1"), F.count_if(~F.col("_g")).alias("n2"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sum of ranks of positive and negative differences, zeros left out."""
    d = df.select((F.col(a) - F.col(b)).alias("_d")).where("_d <> 0").withColumn("_abs", F.abs("_d"))
    r = average_ranks(d, "_abs", "_rank")
    return r.agg(F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_rank"))), F.lit(0.0)).alias("w_minus"))


def with_p(df: DataFrame, law: str, *columns: str) -> DataFrame:
    """A test's row with its probability `p` under the hypothesis: law chisquare (value, degrees), t (value, degrees; two-sided), f (value, both degrees) or normal (value; two-sided). Unknown where the value or the degrees are, or none are free."""
    of = {"chisquare": chisqprob, "t": tprob, "f": lambda f, a, b: fprob(a, b, f), "normal": lambda z: 2 * zprob(-abs(z))}[law]

    @F.pandas_udf("double")
    def p(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(v is None or math.isnan(v) for v in r) or min(r[1:], default=1) <= 0 else of(*r) for r in rows.astype(float).itertuples(index=False, name=None)], dtype="float64")

    return df.withColumn("p", p(F.struct(*columns)))


def chisquare2d(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, df, p, cramers_v, contingency): independence of two columns, over the values there are; rows with an unknown value are left out."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("o"))
    rows, columns = (t.groupBy(c).agg(F.sum("o").alias(f"n{c}")) for c in "ab")
    t = t.join(rows, "a").join(columns, "b").join(F.broadcast(t.agg(F.sum("o").alias("n"))))
    e = F.col("na") * F.col("nb") / F.col("n")
    found = t.agg(F.max("n").alias("n"), F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("there"), F.sum(e).alias("e"), F.count("*").alias("cells"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    n = F.col("n")
    chi2 = F.col("there") + F.when(F.col("cells") < F.col("ka") * F.col("kb"), n - F.col("e")).otherwise(0.0)  # cells without rows
    found = found.select(chi2.alias("chi2"), F.greatest((F.col("ka") - 1) * (F.col("kb") - 1), F.lit(0)).alias("df"), F.sqrt(F.try_divide(chi2, n * (F.least("ka", "kb") - 1))).alias("cramers_v"), F.sqrt(F.try_divide(chi2, chi2 + n)).alias("contingency"))
    return with_p(found, "chisquare", "chi2", "df")


def anova_rel(df: DataFrame, subject: str, treatment: str, value: str) -> DataFrame:
    """(f, df_between, df_error, p) of repeated measures, a row for each subject and treatment; f is -1 and p 0 where nothing is left to err. Subjects that lack a treatment, or have one twice, are an error."""
    x = F.col(value).cast("double")
    t = df.where(x.isNotNull()).select(F.col(subject).alias("s"), F.col(treatment).alias("t"), x.alias("x"))
    of = t.groupBy("t").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx")).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.min("n").alias("least"), F.sum("x").alias("g"), F.sum("xx").alias("xx"), F.sum(F.col("x") * F.col("x")).alias("tt"))
    by = t.groupBy("s").agg(F.sum("x").alias("x"), F.count("*").alias("m"), F.count_distinct("t").alias("d")).agg(F.count("*").alias("subjects"), F.min("d").alias("d"), F.max("m").alias("m"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    k, n, c = F.col("k"), F.col("n"), F.col("g") * F.col("g") / (F.col("k") * F.col("n"))
    whole = F.assert_true((n == F.col("least")) & (n == F.col("subjects")) & (F.col("d") == k) & (F.col("m") == k), "subjects lack treatments or repeat them")
    between, error = F.col("tt") / n - c, F.col("xx") - F.col("tt") / n - (F.col("ss") / k - c)
    none = error < 1e-20
    found = of.join(F.broadcast(by)).where(whole.isNull()).select(F.when(none, -1.0).otherwise(F.try_divide(between / (k - 1), error / ((k - 1) * (n - 1)))).alias("f"), (k - 1).alias("df_between"), ((k - 1) * (n - 1)).alias("df_error"))
    return with_p(found, "f", "f", "df_between", "df_error").withColumn("p", F.when(F.col("f") == -1, 0.0).otherwise(F.col("p")))


def ranksums(df: DataFrame, name: str, group: Column) -> DataFrame:
    """(z, p) of the first group's sum of ranks, ties sharing theirs."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = mann_whitney(df.where(F.col(name).isNotNull() & group.isNotNull()), name, group)
    return with_p(u.select(F.try_divide(F.col("u") - n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z")), "normal", "z")


def loess(points: Sequence[tuple[float, float]], at: Sequence[float], window: float = 0.5) -> list[float]:
    """Local linear fits with tricube weights over the nearest share of a few points, all as far as the last one included (see operators.local for tables)."""
    pts = sorted(points)
    k = min(len(pts), max(3, math.ceil(window * len(pts))))
    out = []
    for x0 in at:
        far = sorted(abs(x - x0) for x, _ in pts)[k - 1]
        near = [p for p in pts if abs(p[0] - x0) <= far]
        far = far or 1.0
        w = [(1 - min(abs(x - x0) / (far * 1.0000001), 1) ** 3) ** 3 for x, _ in near]
        sw = sum(w)
        mx, my = sum(a * x for a, (x, _) in zip(w, near, strict=True)) / sw, sum(a * y for a, (_, y) in zip(w, near, strict=True)) / sw
        sxx = sum(a * (x - mx) ** 2 for a, (x, _) in zip(w, near, strict=True))
        sxy = sum(a * (x - mx) * (y - my) for a, (x, y) in zip(w, near, strict=True))
        out.append(my + (sxy / sxx if sxx > 1e-300 else 0.0) * (x0 - mx))
    return out
