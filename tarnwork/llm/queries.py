"""The registered queries of the training-data operators: op1 to op13."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm import warc

    path = warc.scratch_archives(spark)
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    found = warc.read_archives(spark, path).select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A response's figures are those of the payload read; a revisit's payload is elsewhere."""
        for part in batches:
            rows = part.select(["record_type", "payload_digest", "payload_bytes", "payload"]).to_pylist()
            own = [(warc.digest(r["payload"]), len(r["payload"])) if r["record_type"] == "response" else (r["payload_digest"], r["payload_bytes"]) for r in rows]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([n for _, n in own], pa.int64()), pa.array([x for x, _ in own], pa.string()), part.column("record_type"), part.column("refers_to")], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return found.mapInArrow(check, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    links = train(docs, table(spark, sf_dir, "labels"), ["quality", "toxic"])
    found = score(docs, links, ["p_quality", "p_toxic"])
    return found.select("doc_id", "p_quality", "p_toxic", F.coalesce(F.col("p_toxic") >= 0.5, F.lit(False)).alias("toxic"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.bpe import encode

    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), keep_text=False, packed=True, decoded_col="decoded")
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.chat import expand, read_back
    from tarnwork.llm.common import written

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    found = read_back(written(expand(rows.unionByName(extra)), "chat"))
    loss = F.array_join("loss", "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.common import scratch_path
    from tarnwork.llm.tokenfile import read_token_files, write_token_files

    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path())

    @F.pandas_udf("long")
    def crc(column: pd.Series) -> pd.Series:
        return column.map(lambda x: zlib.crc32(x.astype("<u4").tobytes()))

    return read_token_files(spark, path).select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), crc("ids").alias("ids_crc32"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.lines import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.lm import build, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)))
    return score(docs, build(docs.where("not held_out").select("text")))


OP8_SQL = """
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
    select *, regexp_replace(text, '([<\\[])(\\\\*)(\\||/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g') as escaped from c
), f as (
    select *, sum(length(escaped) + length(role) + 23) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto,
        row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from e
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(upto) filter (where role = 'assistant' or back = 1) as bigint) as formatted_chars
from f group by conv_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.quality import judge

    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("p_good") >= 0.5)).alias("kept"), "p_good")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.jaccard import join

    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.dualtree import top_k

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, d.vec_id, list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2]))::bigint as score
    from v q join v d on q.vec_id % 100 = 0 and q.vec_id <> d.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
"""


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.importance import resample

    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte; its table comes from the polynomial.
CRC_SQL = """
recursive steps(b, k, c) as (
    select i::bigint, 0, i::bigint from range(256) r(i)
    union all select b, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from steps where k < 8
), crc_table as (select list(c order by b) as t from steps where k = 8)
"""


def crc_sql(text: str) -> str:
    """Unsigned crc32 of a string's bytes, where crc_table's list is at hand as t."""
    two = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::int, 2))::bigint)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], {two}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


OP12_SQL = f"""
with {CRC_SQL}, texts as (
    select 0 as side, doc_id as id, row_number() over () as no, text from documents union all select 1, null, row_number() over (), text from benchmark
), words as (
    select side, id, no, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from texts
), runs as (
    select side, no, w[i] as f from words, unnest(range(1, len(w) + 1)) u(i)
    union all select side, no, w[i] || ' ' || w[i + 1] from words, unnest(range(1, len(w))) u(i)
    union all select side, no, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from words, unnest(range(1, len(w) - 1)) u(i)
), counted as (
    select side, no, f, count(*) as n from runs group by all
), bucket as (
    select f, {crc_sql("f")} % 10000 as b from (select distinct f from counted), crc_table
), kept as (
    select side, no, b, sum(n) as n from counted join bucket using (f) group by all
), gain as (
    select b, floor(1000 * ln((t::double + 1) * (s_all::double + 10000) / ((s::double + 1) * (t_all::double + 10000))))::bigint as g
    from (select b, coalesce(sum(n) filter (where side = 0), 0) as s, coalesce(sum(n) filter (where side = 1), 0) as t from kept group by b),
        (select coalesce(sum(n) filter (where side = 0), 0) as s_all, coalesce(sum(n) filter (where side = 1), 0) as t_all from kept)
), weighed as (
    select no, sum(n) as n_features, sum(n * g) as weight from kept join gain using (b) where side = 0 group by no
), scored as (
    select id, no, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
        coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
    from words left join weighed using (no) where side = 0
), ranked as (
    select *, row_number() over (partition by n_words >= 20 order by score desc, id) as r, count(*) filter (where n_words >= 20) over () as n from scored
)
select id as doc_id, n_features, weight, score, case when n_words >= 20 and r <= 5 * n // 100 then r end as rank from ranked
"""


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm import merkle

    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*columns)
    big, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # lower() does the same to plain ASCII, and faster.
    lowered = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate("text", big, small))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf([lowered if c == "text" else F.col(c) for c in columns]))
    found = merkle.manifest(docs, columns, also={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op13_sql(levels: int = 12) -> str:
    """Levels are written out; runs of a tree that has ended go on unchanged, without siblings."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""with {CRC_SQL}, leaves as (
        select doc_id, coalesce('=' || lang, '-') as g, {leaf("text")} as leaf, case when {crc_sql("doc_id::varchar")} % 3 = 0 then {leaf(lowered)} else {leaf("text")} end as own from documents, crc_table
    ), rows as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as no from leaves
    ), n0 as (select g, no, leaf as h from rows)"""]

    def up(name: str, k: int) -> str:
        run = f"(partition by g, no // 8 order by no rows between unbounded preceding and {{}})"
        return f"""{name}l{k} as (
            select g, no, h, count(*) over (partition by g) as size, string_agg(h, '') over (partition by g, no // 8 order by no rows between unbounded preceding and 1 preceding) as a,
                string_agg(h, '') over (partition by g, no // 8 order by no rows between 1 following and unbounded following) as b from {name}{k}
        ), {name}{k + 1} as (
            select g, no // 8 as no, case when any_value(size) = 1 then any_value(h) else sha256(string_agg(h, '' order by no)) end as h from {name}l{k} group by g, no // 8
        )"""

    parts += [up("n", k) for k in range(levels)]
    parts.append(f"m0 as (select '' as g, row_number() over (order by g) - 1 as no, h, g as of from n{levels})")
    parts += [up("m", k) for k in range(4)]
    folded, proof, joins = "own", [], []
    steps = [("n", k, "r.g", f"r.no // {8**k}") for k in range(levels)] + [("m", k, "''", f"top.no // {8**k}") for k in range(4)]
    for name, k, g, no in steps:
        t = f"{name}l{k}"
        joins.append(f"join {t} on {t}.g = {g} and {t}.no = {no}")
        proof += [f"coalesce({t}.a, '')", f"coalesce({t}.b, '')"]
    inner = f"select r.doc_id, r.leaf, r.own, top.h as subroot, m4.h as root, {' || '.join(proof)} as proof, " + ", ".join(f"{n}l{k}.size as {n}s{k}, coalesce({n}l{k}.a, '') as {n}a{k}, coalesce({n}l{k}.b, '') as {n}b{k}" for n, k, _, _ in steps)
    parts.append(f"f_ as ({inner} from rows r join m0 top on top.of = r.g {' '.join(joins)} cross join m4)")
    last, held = "f_", "own"
    for i, (n, k, _, _) in enumerate(steps):
        parts.append(f"f{i} as (select * exclude ({held}), case when {n}s{k} = 1 then {held} else sha256({n}a{k} || {held} || {n}b{k}) end as h{i} from {last})")
        last, held = f"f{i}", f"h{i}"
    return ", ".join(parts) + f" select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, {held} as folded_root, {held} = root as verified from {last}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_bpe, op3_warc, op4_toxicity, op5_token_files, op6_lines, op7_lm, op8_chat, op9_quality, op10_jaccard, op11_topk, op12_resample, op13_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op8_chat": OP8_SQL, "op11_topk": OP11_SQL, "op12_resample": OP12_SQL, "op13_manifest": op13_sql()}
