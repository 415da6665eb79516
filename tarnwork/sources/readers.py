"""Readers: tab-separated with three header lines, prefixed text, CSV, basket, C4.5, ARFF, MULAN, libSVM, SQL, networks, distance matrices.

Headers are read on the driver (a few lines), rows by Spark's own readers.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.schema import Domain, Variable, convert

#: What stands for an unknown value.
UNKNOWN = ("", "?", ".", "~", "*", "NA")
#: Sniffing reads so many lines.
SAMPLE_LINES = 2000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _line): lines, with a number that grows along a file."""
    return spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())


def _head(spark: SparkSession, path: str, n: int) -> list[str]:
    return [r[0] for r in _lines(spark, path).limit(n).collect()]


def _below(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Lines but for those that `_head` has: told by their number, not by their text, which rows may repeat."""
    first = [r[1] for r in _lines(spark, path).limit(n).collect()]
    return _lines(spark, path).where(~F.col("_line").isin(first))


#: Lines of texts that are read on the driver (networks, headers, queries); more are an error.
MOST_LINES = 5_000_000


def _whole(spark: SparkSession, path: str) -> list[str]:
    lines = _head(spark, path, MOST_LINES + 1)
    if len(lines) > MOST_LINES:
        raise ValueError(f"more than {MOST_LINES} lines in {path}")
    return lines


def _head_until(spark: SparkSession, path: str, last: str) -> list[str]:
    """The lines up to the first that begins with `last`, in lower case; all lines where none does."""
    n = 1000
    while True:
        lines = _head(spark, path, n)
        end = next((k for k, line in enumerate(lines, 1) if line.strip().lower().startswith(last)), None)
        if end or len(lines) < n:
            return lines[:end]
        n *= 10
        if n > MOST_LINES:
            raise ValueError(f"no {last} within {MOST_LINES} lines of {path}")


def _known(column: str, unknown: Sequence[str] = UNKNOWN) -> Column:
    c = F.trim(F.col(f"`{column}`"))
    return F.when(~c.isin(*unknown), c)


def _rows(spark: SparkSession, path: str, names: Sequence[str], sep: str, skip: int, **options: str) -> DataFrame:
    """All rows as strings, without the first `skip` lines."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if not skip:
        return spark.read.options(**options).csv(path, schema=schema, sep=sep, header=False)
    lines = _below(spark, path, skip)
    parsed = lines.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": options.get("quote", '"')}).alias("r")) if all(re.fullmatch(r"\w+", n) for n in names) else lines.select(F.split("value", re.escape(sep), -1).alias("a")).select(F.struct(*(F.get("a", i).alias(n) for i, n in enumerate(names))).alias("r"))
    return parsed.select("r.*")


def _typed(df: DataFrame, variables: Sequence[Variable], unknown: Sequence[str] = UNKNOWN) -> DataFrame:
    cols = []
    for v in variables:
        c = _known(v.name, unknown)
        cols.append((F.regexp_replace(c, ",", ".").try_cast("double") if v.kind == "continuous" else c).alias(v.name))
    return convert(df.select(*cols), Domain(tuple(variables)))


def infer(df: DataFrame, names: Sequence[str], unknown: Sequence[str] = UNKNOWN) -> list[Variable]:
    """Kinds of columns of strings by one aggregation: only digits 0-9 discrete, numbers continuous, else discrete unless values rarely repeat."""
    aggs = []
    for n in names:
        c = _known(n, unknown)
        number = F.regexp_replace(c, ",", ".").try_cast("double")
        aggs.append(F.struct(F.count(c).alias("n"), F.count(number).alias("numbers"), F.count_if(c.rlike("^[0-9]$")).alias("digits"), F.approx_count_distinct(c).alias("distinct")).alias(n))
    row = df.agg(*aggs).first()
    out = []
    for n in names:
        r = row[n]
        if r["n"] and r["digits"] == r["n"]:
            kind = "discrete"
        elif r["n"] and r["numbers"] == r["n"]:
            kind = "continuous"
        else:
            kind = "string" if r["distinct"] > 20 and 2 * r["distinct"] > r["n"] else "discrete"
        out.append(Variable(n, kind, "meta" if kind == "string" else "feature"))
    return out


def read_tab(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Three header lines: names, types (c, d, string or a list of values), flags (class, meta, multiclass, i)."""
    names, kinds, flags = (line.split(sep) for line in _head(spark, path, 3))
    flags += [""] * (len(names) - len(flags))
    out = []
    for n, k, f in zip(names, kinds, flags, strict=False):
        parts = f.split()
        if "i" in parts or "ignore" in parts:
            continue
        role = "class" if "class" in parts else "meta" if "meta" in parts or "m" in parts else "multiclass" if "multiclass" in parts else "feature"
        short = k.strip().lower()
        values = () if short in ("c", "continuous", "d", "discrete", "s", "string", "") else tuple(x.replace("\x00", " ") for x in k.replace("\\ ", "\x00").split())
        kind = "continuous" if short in ("c", "continuous") else "string" if short in ("s", "string") else "discrete"
        out.append(Variable(n, kind, role, values))
    return _typed(_rows(spark, path, names, sep, 3), out)


def read_prefixed(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """One header line whose names may carry [cmi][DCS]# prefixes; other kinds are inferred."""
    raw = _head(spark, path, 1)[0].split(sep)
    found = [re.fullmatch(r"(?:([mci]?)([DCS]?)#)?(.*)", x).groups() for x in raw]
    rows = _rows(spark, path, [n for _, _, n in found], sep, 1)
    guessed = {v.name: v for v in infer(rows, [n for _, _, n in found])}
    out = []
    for flag, kind, n in found:
        if flag != "i":
            k = {"D": "discrete", "C": "continuous", "S": "string"}.get(kind or "", guessed[n].kind)
            out.append(Variable(n, k, {"c": "class", "m": "meta"}.get(flag or "", guessed[n].role if k != "string" else "meta")))
    return _typed(rows, out)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, has_header: bool | None = None, unknown: Sequence[str] = UNKNOWN) -> DataFrame:
    """Dialect and header sniffed from the first lines; kinds by shares of numbers and of distinct values."""
    sample = "\n".join(_head(spark, path, SAMPLE_LINES))
    if delimiter is None:
        try:
            delimiter = csv.Sniffer().sniff(sample, ",;\t| ").delimiter
        except csv.Error:
            delimiter = ","
    if has_header is None:
        first = next(csv.reader(io.StringIO(sample), delimiter=delimiter), [])
        has_header = not any(re.fullmatch(r"[-+]?[\d.]+(e[-+]?\d+)?", x.strip(), re.I) for x in first)
    names = next(csv.reader(io.StringIO(sample), delimiter=delimiter), [])
    names = [x.strip() for x in names] if has_header else [f"a{i + 1}" for i in range(len(names))]
    rows = spark.read.csv(path, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), sep=delimiter, header=has_header)
    aggs = [F.struct(F.count(_known(n, unknown)).alias("n"), F.count(_known(n, unknown).try_cast("double")).alias("numbers"), F.approx_count_distinct(_known(n, unknown)).alias("distinct")).alias(n) for n in names]
    row, out = rows.agg(*aggs).first(), []
    for n in names:
        r = row[n]
        numeric = r["n"] and r["numbers"] >= 0.5 * r["n"]
        kind = "continuous" if numeric and not (r["distinct"] < 20 and r["numbers"] < 0.7 * r["n"]) else "discrete" if r["distinct"] < 20 else "string" if r["distinct"] > 0.75 * r["n"] else "discrete"
        out.append(Variable(n, kind, "meta" if kind == "string" else "feature"))
    return _typed(rows, out, unknown)


def read_basket(spark: SparkSession, path: str) -> DataFrame:
    """(row, items): a map of item to quantity per line; quantities of an item given twice add up."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).withColumn("row", F.monotonically_increasing_id())
    items = lines.select("row", F.explode(F.split("value", ",")).alias("x")).where(F.length(F.trim("x")) > 0)
    items = items.select("row", F.trim(F.element_at(F.split("x", "="), 1)).alias("item"), F.coalesce(F.trim(F.get(F.split("x", "="), 1)).try_cast("double"), F.lit(1.0)).alias("q"))
    return items.groupBy("row", "item").agg(F.sum("q").alias("q")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("item", "q"))).alias("items"))


def read_c45(spark: SparkSession, stem: str) -> DataFrame:
    """<stem>.names for the schema, <stem>.data for the rows."""
    lines = [re.sub(r"\|.*", "", x).strip().rstrip(".") for x in _whole(spark, f"{stem}.names")]
    lines = [x for x in lines if x]
    classes = tuple(x.strip() for x in lines[0].split(","))
    out = []
    for line in lines[1:]:
        n, k = (x.strip() for x in line.split(":", 1))
        if k == "ignore":
            out.append(Variable(n, "string", "meta"))
        else:
            out.append(Variable(n, "continuous") if k == "continuous" else Variable(n, "discrete", values=tuple(x.strip() for x in k.split(","))))
    out.append(Variable("class", "discrete", "class", classes))
    rows = spark.read.csv(f"{stem}.data", schema=T.StructType([T.StructField(v.name, T.StringType()) for v in out]), ignoreLeadingWhiteSpace=True)
    rows = rows.withColumn("class", F.regexp_replace("class", r"\.\s*$", ""))
    return _typed(rows, out)


#: A quoted piece of an ARFF line; a backslash takes the next character as it is.
QUOTED = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""


def _unquoted(cell: Column) -> Column:
    """A cell's value: unknown where it stands for that without quotes; between quotes, what it holds."""
    inside = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit("\\\\"), F.lit("\x00"))
    for mark, is_ in (("\\n", "\n"), ("\\r", "\r"), ("\\'", "'"), ('\\"', '"'), ("\x00", "\\")):
        inside = F.replace(inside, F.lit(mark), F.lit(is_))
    return F.when(cell.rlike(f"^(?:{QUOTED})$"), inside).when(~cell.isin(*UNKNOWN), cell)


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1]) if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def read_arff(spark: SparkSession, path: str, classes: Sequence[str] = ()) -> DataFrame:
    """@attribute lines until @data; nominal lists, numeric, string. `classes` become several classes, else the last attribute is one.

    Rows may be quoted, or sparse: {place value, ...}. What follows a % outside quotes is a comment.
    """
    head, out = _head_until(spark, path, "@data"), []
    for line in head:
        found = re.match(rf"@attribute\s+({QUOTED}|\S+)\s+(.*)", line.strip(), re.I)
        if found:
            name, kind = _unquote(found[1]), found[2].strip()
            if kind.startswith("{"):
                inside = kind[1 : kind.rfind("}")] if "}" in kind else kind[1:]
                values = [_unquote(x.strip()) for x in re.findall(rf"\s*({QUOTED}|[^,]+)\s*(?:,|$)", inside)]
                out.append(Variable(name, "discrete", values=tuple(values)))
            else:
                out.append(Variable(name, "continuous" if kind.lower() in ("numeric", "real", "integer") else "string", "feature" if kind.lower() in ("numeric", "real", "integer") else "meta"))
    roles = {c: "multiclass" for c in classes} or ({out[-1].name: "class"} if out else {})
    out = [Variable(v.name, v.kind, roles.get(v.name, v.role), v.values) for v in out]
    plain = F.regexp_extract("value", rf"""^((?:{QUOTED}|[^%'"]++|['"])*+)""", 1)
    body = _below(spark, path, len(head)).select(F.trim(plain).alias("x")).where("x <> ''")
    cells = F.regexp_extract_all("x", F.lit(rf"\s*({QUOTED}|[^,]*?)\s*(?:,|$)"), F.lit(1))
    pair = rf"\s*(\d+)\s+({QUOTED}|[^,]*?)\s*(?:,|$)"
    inside = F.regexp_extract("x", r"^\{(.*)\}$", 1)
    places = F.map_from_arrays(*(F.regexp_extract_all(inside, F.lit(pair), F.lit(k)) for k in (1, 2)))
    body = body.select(F.when(~F.startswith("x", F.lit("{")), cells).alias("a"), F.when(F.startswith("x", F.lit("{")), places).alias("m"))
    rows = body.select(*(_unquoted(F.coalesce(F.get("a", i), F.try_element_at("m", F.lit(str(i))))).alias(v.name) for i, v in enumerate(out)))
    return convert(rows.select(*(F.col(f"`{v.name}`").try_cast("double").alias(v.name) if v.kind == "continuous" else f"`{v.name}`" for v in out)), Domain(tuple(out)))


def read_mulan(spark: SparkSession, arff: str, xml: str) -> DataFrame:
    labels = re.findall(r'<label\s+name="([^"]+)"', "\n".join(_whole(spark, xml)))
    return read_arff(spark, arff, labels)


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("libsvm").load(path)


def read_sql(spark: SparkSession, url: str | None, query: str, class_name: str = "class", metas: Sequence[str] = (), discrete: Sequence[str] = (), **options: str) -> DataFrame:
    """A query over JDBC (url) or over the session's own tables; columns get roles by name."""
    df = spark.read.format("jdbc").options(url=url, query=query, **options).load() if url else spark.sql(query)
    out = []
    for f in df.schema:
        kind = "discrete" if f.name in discrete else "string" if isinstance(f.dataType, (T.StringType, T.TimestampType, T.DateType)) else "continuous"
        role = "class" if f.name == class_name else "meta" if f.name in metas or kind == "string" else "feature"
        out.append(Variable(f.name, kind, role))
    return convert(df, Domain(tuple(out)))


def read_sql_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines `key: value` (uri, class, metas, discrete), then the query."""
    about: dict[str, str] = {}
    lines = _whole(spark, path)
    while lines and (found := re.match(r"(uri|class|metas|discrete)\s*:\s*(.*)", lines[0])):
        about[found[1]] = found[2].strip()
        lines.pop(0)
    words = lambda k: [x for x in re.split(r"[,\s]+", about.get(k, "")) if x]
    return read_sql(spark, about.get("uri"), "\n".join(lines), about.get("class", "class"), words("metas"), words("discrete"))


def read_pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a .net file: section numbers come from a running count over lines in file order."""
    lines = _whole(spark, path)
    section, vertices, edges = "", [], []
    for line in lines:
        if line.startswith("*"):
            section = line[1:].split()[0].lower()
        elif section == "vertices" and (m := re.match(r'\s*(\d+)(?:\s+"([^"]*)"|\s+(\S+))?', line)):
            vertices.append((int(m[1]), m[2] or m[3]))
        elif section in ("edges", "arcs") and len(p := line.split()) >= 2:
            edges.append((int(p[0]), int(p[1]), float(p[2]) if len(p) > 2 else 1.0, section == "arcs"))
    return spark.createDataFrame(vertices, "id long, label string"), spark.createDataFrame(edges, "src long, dst long, weight double, directed boolean")


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    text = "\n".join(_whole(spark, path))
    nodes = [(int(m[1]), (re.search(r'label\s+"([^"]*)"', b) or [None, None])[1]) for b in re.findall(r"node\s*\[(.*?)\]", text, re.S) if (m := re.search(r"\bid\s+(\d+)", b))]
    edges = [(int(s[1]), int(t[1]), float((re.search(r"(?:weight|value)\s+([\d.eE+-]+)", b) or [None, 1])[1])) for b in re.findall(r"edge\s*\[(.*?)\]", text, re.S) if (s := re.search(r"source\s+(\d+)", b)) and (t := re.search(r"target\s+(\d+)", b))]
    return spark.createDataFrame(nodes, "id long, label string"), spark.createDataFrame(edges, "src long, dst long, weight double")


def _numbered_lines(spark: SparkSession, path: str, start: int) -> DataFrame:
    """(i, value): lines with their number, of files in the order of their names. What is counted is a row for each split of a file; lines are not shuffled."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"))
    splits = lines.groupBy("_f", "_s").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_f", "_s", (before - F.col("_first") + start).alias("_at"))
    return lines.join(F.broadcast(splits), ["_f", "_s"]).select((F.col("_m") + F.col("_at")).alias("i"), "value")


def read_distance_labels(spark: SparkSession, path: str) -> DataFrame:
    """(i, label) of a triangular text matrix."""
    return _numbered_lines(spark, path, -1).where("i >= 0").select("i", F.get(F.split(F.trim("value"), r"\s+", 2), F.lit(0)).alias("label"))


def read_distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, d), i > j, of a triangular text matrix: a line with the size and words, then a row per line (its label first)."""
    lines = _numbered_lines(spark, path, -1).where("i >= 0")
    parts = F.split(F.trim("value"), r"\s+")
    cells = lines.select("i", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("j", "d"))
    return cells.where("j < i").select("i", "j", F.col("d").try_cast("double").alias("d"))


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".tab": read_tab, ".tsv": read_tab, ".txt": read_prefixed, ".csv": read_csv, ".basket": read_basket, ".arff": read_arff, ".svm": read_libsvm, ".sql": read_sql_file,
    ".parquet": lambda s, p: s.read.parquet(p),
}


def register(extension: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    FORMATS[extension] = reader


def read(spark: SparkSession, path: str) -> DataFrame:
    """By extension."""
    for extension, reader in FORMATS.items():
        if path.endswith(extension):
            return reader(spark, path)
    if path.endswith((".data", ".names")):
        return read_c45(spark, path.rsplit(".", 1)[0])
    raise ValueError(f"no reader for {path}")


def enumerate_rows(spark: SparkSession, values: dict[str, Sequence[str]]) -> DataFrame:
    """All combinations of value lists: numbers decoded digit by digit, so nothing is joined."""
    total = 1
    for v in values.values():
        total *= len(v)
    df, base = spark.range(total), 1
    for name, v in values.items():
        df = df.withColumn(name, F.get(F.array(*map(F.lit, v)), (F.floor(F.col("id") / base) % len(v)).cast("int")))
        base *= len(v)
    return df.drop("id")


def from_rows(spark: SparkSession, rows: Sequence[Sequence[object]], domain: Domain) -> DataFrame:
    """Lists of values, in the order of the domain's variables."""
    kinds = T.StructType([T.StructField(v.name, T.DoubleType() if v.kind == "continuous" else T.StringType()) for v in domain.variables])
    return convert(spark.createDataFrame([tuple(r) for r in rows], kinds), domain)


def from_numpy(spark: SparkSession, array: object, names: Sequence[str] | None = None) -> DataFrame:
    import numpy as np

    mask = np.ma.getmaskarray(array) if isinstance(array, np.ma.MaskedArray) else None
    rows = [[None if mask is not None and mask[i, j] else float(x) for j, x in enumerate(row)] for i, row in enumerate(np.asarray(array))]
    names = list(names or [f"a{i + 1}" for i in range(np.asarray(array).shape[1])])
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
