"""The queries op1 to op10 over whole tables, and the SQL that says what they should return."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, minhash_forest, nn_descent, rabin_karp, rlbwt, sentencepiece_codec, toxicity, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_digest(df: DataFrame, drop: list[str], **columns: tuple[str, Callable]) -> DataFrame:
    """df with string or long columns that a function of the row (a dict) gives, less some columns."""
    kept = [f for f in df.schema.fields if f.name not in drop]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[str, list] = {c: [] for c in columns}
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                for c, (_, f) in columns.items():
                    new[c].append(f(row))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(new[c], pa.string() if kind == "string" else pa.int64()) for c, (kind, _) in columns.items())], [*(f.name for f in kept), *columns])

    return df.mapInArrow(add, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} {kind}" for c, (kind, _) in columns.items())]))


URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op6_rlbwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(
        rlbwt.find_repeats(table(spark, sf_dir, "documents")),
        ["text", "spans"],
        n_bytes=("long", lambda r: len((r["text"] or "").encode())),
        n_removed=("long", lambda r: sum(b - a for a, b in r["spans"])),
        n_spans=("long", lambda r: len(r["spans"])),
        kept_sha256=("string", lambda r: rlbwt.kept_digest(r["text"], r["spans"])),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    examples = chat_format.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    read = (
        examples.withColumn("loss", F.struct("example", chat_format.loss_text(F.col("formatted"), F.col("mask_start"), F.col("mask_chars")).alias("text")))
        .groupBy("conv_id")
        .agg(F.max_by("formatted", "example").alias("whole"), F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"), F.sum(F.char_length("formatted")).alias("formatted_chars"))
        .withColumn("turns", chat_format.read_turns(F.col("whole")))
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = labels.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.train(docs, seen))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rabin_karp.repeated_windows(table(spark, sf_dir, "documents"))
    return with_digest(
        found, ["text", "spans"], n_removed=("long", lambda r: sum(b - a for a, b in r["spans"])), kept_sha256=("string", lambda r: rabin_karp.kept_digest(r["text"], r["spans"]))
    )


#: A parameter: the model is part of the machine, not of this repository.
TOKENIZER = os.environ.get("TESSERA_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.summaries(table(spark, sf_dir, "documents"), TOKENIZER)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_url_filter, op2_warc, op3_nn_descent, op4_minhash_forest, op5_decontaminate, op6_rlbwt, op7_chat_format, op8_toxicity, op9_rabin_karp, op10_sentencepiece)}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED = r"'[^\x20\x09-\x0D]+'"

SQL = {
    "op1_url_filter": """
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(r_host, r_path, r_verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best as (
  select host, path, arg_max(r_host || r_path, length(r_host || r_path)) as rule, arg_max(r_verdict, length(r_host || r_path)) as verdict
  from (select distinct host, path from p) join r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
  group by host, path)
select page_id, p.host, p.path, rule, coalesce(verdict, 'allow') as verdict from p left join best on p.host = best.host and p.path = best.path
""",
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
g as (select h, max(page_id) as response from p group by h)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(((('0x' || substr(p.h, cast(5 * i // 4 + 1 as bigint), 2))::int >> cast(3 - (5 * i) % 4 as int)) & 31) as bigint), 1)), '') as payload_digest,
  case when page_id = response then 'response' else 'revisit' end as record_type,
  case when page_id = response then null else response end as refers_to
from p join g on p.h = g.h
""",
    "op4_minhash_forest": f"""
with recursive d as (select doc_id, regexp_extract_all({LOWERED}, {SPACED}) as w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i:i + 3], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on r.other = e.a),
m as (select doc_id, min(other) as component_id from r group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, d.doc_id = coalesce(component_id, d.doc_id) as kept
from d left join n on d.doc_id = n.doc_id left join m on d.doc_id = m.doc_id
""",
    "op5_decontaminate": f"""
with d as (select doc_id, regexp_extract_all({LOWERED}, {ALNUM}) as w from documents),
b as (select item_id, regexp_extract_all({LOWERED}, {ALNUM}) as w from benchmark),
bw as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
widths as (select distinct n from bw),
dw as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, widths where len(w) >= n)),
hits as (select doc_id, item_id, dw.n, i from dw join bw on dw.n = bw.n and dw.g = bw.g),
words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id
""",
    "op6_rlbwt": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents),
win as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as g from (select doc_id, h, unnest(range(0, n - 99)) as i from d where n >= 100)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from win) where k > 1),
groups as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from later),
runs as (select doc_id, min(i) as a, max(i) + 100 as b from (select doc_id, i, sum(case when gap is null or gap > 100 then 1 else 0 end) over (partition by doc_id order by i) as run from groups) group by doc_id, run),
kept as (
  select doc_id, string_agg(substr(h, 2 * from_i + 1, 2 * (to_i - from_i)), '' order by from_i) as h, sum(to_i - from_i) as n_kept
  from (
    select d.doc_id, d.h, coalesce(lag(b) over (partition by d.doc_id order by a), 0) as from_i, a as to_i from d join runs on d.doc_id = runs.doc_id
    union all select d.doc_id, d.h, (select coalesce(max(b), 0) from runs where runs.doc_id = d.doc_id), n from d)
  group by doc_id),
spans as (select doc_id, count(*) as n_spans from runs group by doc_id)
select d.doc_id, d.n as n_bytes, cast(d.n - n_kept as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(kept.h)) as kept_sha256
from d join kept on d.doc_id = kept.doc_id left join spans on d.doc_id = spans.doc_id
""",
    "op7_chat_format": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
    length(regexp_replace(regexp_replace(text, '\\', 'xx', 'g'), '(</?s>|\[/?INST\])', '\1x', 'g')) as body
  from c window w as (partition by conv_id order by turn, role, text)),
f as (
  select *, sum(case when role = 'assistant' then 7 + body else 23 + length(url_encode(role)) + body end) over (partition by conv_id order by i) as upto from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (role = 'assistant' or i = n) as bigint) as formatted_chars
from f group by conv_id
""",
    "op9_rabin_karp": f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
rep as (select doc_id, i from win where g in (select g from win group by g having count(*) > 1)),
gone as (select distinct doc_id, k from (select doc_id, unnest(range(i, i + 35)) as k from rep)),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
kept as (select doc_id, string_agg(word, ' ' order by k) as s from words anti join gone using (doc_id, k) group by doc_id),
n as (select doc_id, count(*) as n_removed from gone group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join n on d.doc_id = n.doc_id left join kept on d.doc_id = kept.doc_id
""",
}
