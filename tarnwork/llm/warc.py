"""WARC archives: a writer, and a PySpark data source that reads them.

Format `tarnwork_warc`. Planning: every archive is cut into byte ranges of `split_bytes` by its size alone; a range's task reads the records
that start in it (records of this writer are gzip members of their own; the archive's index is a list of record starts, in which the task
finds its own by bisection; archives without an index are read whole, by one task each). Predicates on `record_type` and on header columns are pushed
down (equality, IN, comparisons, null tests): of each record the first bytes are read, the header block is inflated and parsed, and a record
that does not pass, or whose payload no column needs, has its payload skipped: not decoded, and not read where it is beyond those bytes.
Header names are taken in any case, and folded lines are joined. The payload of an HTTP response is what follows its HTTP head.

Writing: `write_archives` gives each row a record in the archive of its task; equal payloads from `min_bytes` on are
stored once, in the record of the smallest id, others are revisit records that name it (`WARC-Refers-To`).

Defined results: a null payload is an empty one; a null id is written as an empty one and read as null; repeated ids are
records of their own (of equal payloads all records but those of the smallest id revisit it; repeated rows of that id are all responses); an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not
from pyspark.sql.types import StructType

from tarnwork.llm.common import as_bytes, scratch_path, slices

SCHEMA = "record_type string, record_id string, page_id long, uri string, date string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "page_id": "X-Page-ID", "uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "X-Refers-To-Page", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length"}
_LONGS = ("page_id", "refers_to", "payload_bytes")
_DATE = "2000-01-01T00:00:00Z"
#: Parts into which the copies of a payload are dealt.
SALTS = 16
#: Bytes of a record that are read to get its header.
HEAD = 4096


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: str, uri: str, payload: bytes, payload_digest: str, refers_to: str | None, place: str = "") -> bytes:
    """One gzip member: the headers, then the block (empty for a revisit). `place` tells revisit records of one page apart."""
    block = b"" if kind == "revisit" else payload
    name = f"<urn:page:{page_id}:{place if kind == 'revisit' else payload_digest}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Page-ID: {page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{payload_digest}>", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def write_archives(df: DataFrame, path: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record per row below `path`, one archive (and its index) per task.

    Which record holds a payload is found from digests alone. To learn it, rows are shuffled once with their payloads, by digest and a salt, so that
    the copies of one payload go to many tasks.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [x or b"" for x in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(digest, found), pa.string()), pa.array(map(len, found), pa.int64())], names=["id", "digest", "bytes"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).cast("string").alias("payload"))
    held = rows.select("id", "payload").mapInArrow(digests, "id long, digest string, bytes long")
    held = held.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copies = held.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(k) for k in range(3)] + [pa.array([digest(x or b"") for x in as_bytes(part.column(2))], pa.string())], names=["id", "uri", "payload", "digest"])

    salted = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    coded = rows.mapInArrow(with_digest, "id long, uri string, payload string, digest string").withColumn("salt", F.pmod(F.xxhash64("id", "uri"), F.lit(SALTS)).cast("int"))
    joined = coded.join(salted, ["digest", "salt"], "left")
    fs, inner = open_fs(path)
    fs.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, inner = open_fs(path)
        name, attempt = f"{inner}/part-{context.partitionId():05d}.warc.gz", context.taskAttemptId()
        starts, at = [], 0
        with fs.open_output_stream(f"{name}.{attempt}.tmp") as out:
            for part in slices(batches, 64):
                columns = (part.column(c).to_pylist() for c in ("id", "uri", "digest", "first"))
                for i, uri, own, first, payload in zip(*columns, as_bytes(part.column("payload")), strict=True):
                    revisit = first is not None and i != first
                    data = record("revisit" if revisit else "response", "" if i is None else str(i), (uri or "").replace("\r", "%0D").replace("\n", "%0A"), payload or b"", own, str(first) if revisit else None, f"{context.partitionId()}:{len(starts)}")
                    out.write(data)
                    starts.append(at)
                    at += len(data)
        with fs.open_output_stream(f"{name}.{attempt}.index.tmp") as out:
            out.write(np.array(starts, "<u8").tobytes())
        fs.move(f"{name}.{attempt}.index.tmp", f"{name}.index")  # a retried task writes the same again
        fs.move(f"{name}.{attempt}.tmp", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(starts)], pa.int64())], names=["archive", "records"])

    joined.select("id", "uri", "payload", "digest", "first").mapInArrow(write, "archive string, records long").agg(F.sum("records")).collect()


class Range(InputPartition):
    """The records of an archive that start in [begin, end); all of an archive without an index (end is None)."""

    def __init__(self, path: str, begin: int, end: int | None, size: int) -> None:
        super().__init__((path, begin, end, size))
        self.path, self.begin, self.end, self.size = path, begin, end, size


_TESTS = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x,
}


def _passes(found: dict, test: Filter) -> bool:
    """Whether a record's header columns pass; unknown counts as no, as in SQL."""
    if isinstance(test, Not):
        return found.get(test.child.attribute[0]) is not None and not _passes(found, test.child)
    value = found.get(test.attribute[0])
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, IsNotNull):
        return value is not None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    return value is not None and _TESTS[type(test)](value, test.value)


def _pushable(test: Filter) -> bool:
    if isinstance(test, Not):
        return type(test.child) in (EqualTo, In) and _pushable(test.child)
    return (type(test) in _TESTS or isinstance(test, (IsNull, IsNotNull, EqualNullSafe))) and len(test.attribute) == 1 and test.attribute[0] in _HEADERS


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 16 << 20))
        self.names = schema.names
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for test in filters:
            if _pushable(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        fs, inner = open_fs(self.path)
        files = {f.path: f for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.is_file}
        out: list[InputPartition] = []
        for path, info in sorted(files.items()):
            if not path.endswith((".warc", ".warc.gz")):
                continue
            if f"{path}.index" in files:
                out += [Range(path, at, min(at + self.split, info.size), info.size) for at in range(0, info.size, self.split)]
            else:
                out.append(Range(path, 0, None, info.size))
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = open_fs(self.path)
        rows: list[dict] = []
        size = 0
        for found in _records(fs, partition, self.tests, "payload" in self.names):
            rows.append(found)
            size += len(found.get("payload") or b"")
            if len(rows) >= 1024 or size > 8 << 20:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary()} | dict.fromkeys(_LONGS, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in self.names], names=self.names)


def _parsed(head: bytes) -> tuple[dict, int, bool]:
    """The header columns, the length of the block that follows, and whether that is an HTTP message."""
    text = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace"))  # folded lines
    pairs = (x.split(":", 1) for x in re.split(r"\r?\n", text)[1:] if ":" in x)
    headers = {k.strip().lower(): v.strip() for k, v in pairs}
    found = {c: headers.get(h.lower()) for c, h in _HEADERS.items()}
    found |= {c: int(found[c]) if re.fullmatch(r"-?\d+", found[c] or "") else None for c in _LONGS}
    if (found["payload_digest"] or "").startswith("sha1:"):
        found["payload_digest"] = found["payload_digest"][5:]
    length = int(headers.get("content-length") or 0)
    http = headers.get("content-type", "").startswith("application/http")
    if found["payload_bytes"] is None and not http:
        found["payload_bytes"] = length
    return found, length, http


def _payload(block: bytes, http: bool) -> bytes:
    return re.split(rb"\r?\n\r?\n", block, maxsplit=1)[-1] if http else block


def _starts(fs: pafs.FileSystem, part: Range) -> Iterator[tuple[int, int]]:
    """(start, end) of the range's records, from its slice of the index."""
    with fs.open_input_file(f"{part.path}.index") as f:
        n = f.size() // 8

        def at(k: int) -> int:
            f.seek(8 * k)
            return int.from_bytes(f.read(8), "little")

        low, high = 0, n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if at(mid) < part.begin else (low, mid)
        while low < n:
            f.seek(8 * low)
            own = np.frombuffer(f.read(8 * 8193), "<u8").tolist()
            for start, end in zip(own, [*own[1:], part.size], strict=True):
                if start >= part.end:
                    return
                if low + 1 < n and end == part.size:  # the slice's last start: its end is in the next one
                    break
                yield start, end
                low += 1


def _stream(fs: pafs.FileSystem, part: Range, tests: list[Filter], payload: bool) -> Iterator[dict]:
    """Records of an archive without an index."""
    with fs.open_input_stream(part.path, compression=None) as raw:
        data = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if part.path.endswith(".gz") else io.BufferedReader(raw)
        while line := data.readline():
            if not line.strip():
                continue
            head = line
            while (line := data.readline()).strip():
                head += line
            found, length, http = _parsed(head)
            wanted = all(_passes(found, t) for t in tests)
            block = data.read(length) if wanted and payload else b""
            left = length - len(block)
            while left > 0 and (skipped := data.read(min(left, 1 << 20))):
                left -= len(skipped)
            if wanted:
                yield found | ({"payload": _payload(block, http)} if payload else {})


def _records(fs: pafs.FileSystem, part: Range, tests: list[Filter], payload: bool) -> Iterator[dict]:
    """Records of a range that pass: headers are read and inflated first, the rest only where it is wanted."""
    if part.end is None:
        yield from _stream(fs, part, tests, payload)
        return
    with fs.open_input_file(part.path) as f:
        for start, end in _starts(fs, part):
            f.seek(start)
            data = f.read(min(HEAD, end - start))
            inflater, taken = zlib.decompressobj(31), len(data)
            head = inflater.decompress(data, 2048)
            while b"\r\n\r\n" not in head and (inflater.unconsumed_tail or start + taken < end):
                data = inflater.unconsumed_tail
                if not data:
                    data = f.read(min(HEAD, end - start - taken))
                    taken += len(data)
                head += inflater.decompress(data, 2048)
            head, _, block = head.partition(b"\r\n\r\n")
            found, length, http = _parsed(head)
            if not all(_passes(found, t) for t in tests):
                continue
            if payload:
                block += inflater.decompress(inflater.unconsumed_tail + f.read(end - start - taken)) + inflater.flush()
                found["payload"] = _payload(block[:length], http)
            yield found


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarnwork_warc"

    def schema(self) -> str:
        return SCHEMA if self.options.get("payload", "true") != "false" else SCHEMA.removesuffix(", payload binary")

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)


def read_archives(spark: SparkSession, path: str, *, payload: bool = True, split_bytes: int = 16 << 20) -> DataFrame:
    """Records below `path`, as SCHEMA; without `payload`, no payload is ever inflated."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("tarnwork_warc").option("payload", str(payload).lower()).option("split_bytes", split_bytes).load(path)


def scratch_archives(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
