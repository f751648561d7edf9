"""Whole pipelines, scorers, and streams in their batch form."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import similarity as S
from ..operators import copies, embedding
from ..operators import pairs as P
from ..sources import tasks as T
from ..sources.records import dense_index
from ..sources.shared import fresh_path
from ..streaming import answers as live
from .base import COS, EDGES, VECTORS, VOTES, edges, query, table, vectors, votes
from .graphs import components_sql
from .workflow import Workflow

TOKENS = "list_distinct(regexp_extract_all(lower(text), '[^ \\x09-\\x0D]+'))"


@query(f"""with recursive d as (select doc_id, {TOKENS} as t from documents), f as (select doc_id, t, len(t) as n, unnest(t) as x from d where len(t) > 0),
m as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as k from f a join f b on a.x = b.x and a.doc_id < b.doc_id and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n group by all),
g as (select a, b from m where k >= 0.8 * (na + nb - k)), {components_sql('g')}
select doc_id as id, coalesce(component, doc_id) as label from documents left join n on doc_id = node""")
def pipeline_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Which documents are copies of each other: token sets, MinHash bands as blocks, Jaccard of at least 0.8, components.

    24 bands of four values miss a pair at the threshold with a probability of 3 in a million.
    """
    return dedup(table(spark, d, "documents"), 0.8)


def dedup(docs: DataFrame, least: float) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \x09-\x0D]+"), lambda t: t != "")
    sets = docs.select(F.col("doc_id").alias("id"), F.array_distinct(words).alias("items"))
    return copies.near_copies(sets, least, bands=24, rows=4)


@query(f"with {EDGES} select a, b, round(case when (a + b) % 3 = 0 then 1.0 else 0.25 end, 6)::double as score from e")
def llm_pair(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in scorer in batches; a service would be called at its place."""
    stub = lambda part: [1.0 if (a + b) % 3 == 0 else 0.25 for a, b in zip(part["a"], part["b"], strict=True)]
    return edges(spark, d).select("a", "b").mapInPandas(P.scorer(stub), "a long, b long, score double")


@F.pandas_udf(StringType())
def batch_reply(prompt: pd.Series) -> pd.Series:
    """A stand-in for a service: a fenced JSON reply to a prompt of numbered pairs."""

    def one(text: str) -> str:
        found = re.findall(r"^(\d+): (\d+) / (\d+)$", text, re.M)
        scores = [{"pair": int(k), "score": 1.0 if (int(a) + int(b)) % 3 == 0 else 0.25} for k, a, b in found]
        return "```json\n" + json.dumps({"scores": scores}) + "\n```"

    return prompt.map(one)


@query(f"with {EDGES} select a, b, round(case when (a + b) % 3 = 0 then 1.0 else 0.25 end, 6)::double as score from e")
def llm_batch(spark: SparkSession, d: str) -> DataFrame:
    """Twenty pairs a prompt, one JSON reply a prompt, read back into scores."""
    rows = dense_index(edges(spark, d).select("a", "b"), "at").withColumn("batch", F.floor(F.col("at") / 20)).withColumn("k", F.col("at") % 20)
    asked = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("k", "a", "b"))).alias("pairs"))
    prompt = F.concat(F.lit("Score each pair from 0 to 1. Reply in JSON.\n"), F.array_join(F.transform("pairs", lambda p: F.concat(p["k"], F.lit(": "), p["a"], F.lit(" / "), p["b"])), "\n"))
    inner = F.regexp_extract(batch_reply(prompt), r"(?s)(\{.*\})", 1)
    scores = F.from_json(inner, "struct<scores: array<struct<pair: bigint, score: double>>>")["scores"]
    return asked.select("pairs", F.explode(scores).alias("s")).select(F.filter("pairs", lambda p: p["k"] == F.col("s.pair"))[0].alias("p"), "s.score").select("p.a", "p.b", "score")


@query(f"""with {VECTORS}, y as (select i.id as a, j.id as b, {COS.format('i.vector', 'j.vector')} as c, i.label = j.label as same from x i join x j on j.id = i.id + 1)
select a, b, case when a % 7 = 0 then c >= 0.85 else same end as match, round(case when a % 7 = 0 then c else 0.9 end, 6)::double as confidence, case when a % 7 = 0 then 'cosine' when same then 'same label' else 'other label' end as explanation from y""")
def llm_verify(spark: SparkSession, d: str) -> DataFrame:
    """A verdict with confidence and explanation for each pair; where the stand-in gives none (every seventh), cosine of 0.85 or more decides."""
    v = vectors(spark, d)
    side = lambda x, k: v.select((F.col("id") + k).alias("at"), F.col("id").alias(x), F.col("vector").alias(f"v{x}"), F.col("label").alias(f"l{x}"))
    pairs = side("a", 1).join(side("b", 0), "at").withColumn("c", S.cosine(F.col("va"), F.col("vb")))
    same = F.col("la") == F.col("lb")
    reply = F.when(F.col("a") % 7 != 0, F.to_json(F.struct(same.alias("match"), F.lit(0.9).alias("confidence"), F.when(same, "same label").otherwise("other label").alias("explanation"))))
    said = F.from_json(reply, "match boolean, confidence double, explanation string")
    told = pairs.withColumn("said", said)
    return told.select("a", "b", F.coalesce("said.match", F.col("c") >= 0.85).alias("match"), F.round(F.coalesce("said.confidence", "c"), 6).alias("confidence"), F.coalesce("said.explanation", F.lit("cosine")).alias("explanation"))


@query(f"with {EDGES} select 'exported' as status, count(*) as lines from e where (p >= 0.5) <> truth")
def llm_finetune(spark: SparkSession, d: str) -> DataFrame:
    """A fine-tuning job as far as it goes without a service: the lines are written, and the job's record says so."""
    path = fresh_path(spark, "finetune")
    T.finetune_lines(edges(spark, d).select(F.concat_ws(",", "a", "b").alias("prompt"), (F.col("p") >= 0.5).alias("model"), "truth")).write.text(path)
    return spark.read.text(path).agg(F.count("*").alias("lines")).select(F.lit("exported").alias("status"), "lines")


@query("select p_partkey as id, md5(substr(p_name, 1, 8000)) as key, p_partkey % 2 = 0 or p_name in (select p_name from part where p_partkey % 2 = 0) as cached, 1.0::double as norm from part")
def emb_api(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by a cache keyed by the md5 of the text: those of even ids are in it, the others are computed."""
    path, r = fresh_path(spark, "vectors"), table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    old = embedding.hashed_vectors(r.where("id % 2 = 0"), "p_name").select(F.md5(F.substring("p_name", 1, embedding.LONGEST)).alias("key"), F.col("vector").alias("value"), F.lit(0).alias("seq"))
    T.save_cache(old, path)
    found = embedding.cached_vectors(r, "p_name", T.load_cache(spark, path))
    return found.select("id", "key", "cached", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@query("select user_id, count(*) as n from events group by 1")
def wf_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A task list with a loop, run by the workflow runner."""
    handlers = {
        "LOAD_TSV_FOR_RC": lambda s, t: s | {"events": table(spark, d, "events")},
        "NGRAPH_CONSTRUCTION": lambda s, t: s | {"rounds": s.get("rounds", 0) + 1},
        "OUTPUT_RESULT": lambda s, t: s | {"out": s["events"].groupBy("user_id").agg(F.count("*").alias("n"))},
    }
    plan = [{"task": "LOAD_TSV_FOR_RC"}, {"task": "LOOP", "times": 3, "tasks": [{"task": "NGRAPH_CONSTRUCTION"}]}, {"task": "OUTPUT_RESULT"}]
    return Workflow(handlers).run(plan)[0]["out"]


@query(f"with {VOTES} select a, b, count(*) as n, round(avg(answer), 6) as mean from v group by 1, 2")
def ss_answers_stream(spark: SparkSession, d: str) -> DataFrame:
    """Answers from files of a folder as a stream, each as an extra vote; the final state."""
    path = fresh_path(spark, "answers")
    rows = votes(spark, d).select("event_id", F.to_json(F.create_map(F.concat_ws(",", "a", "b"), F.col("answer") == 1)).alias("result"))
    rows.repartition(4).write.csv(path, header=True, quote='"', escape='"')
    return live.run_once(live.votes(live.read(spark, path)), spark, "update").groupBy("a", "b").agg(F.max(F.struct("n", "total")).alias("x")).select("a", "b", "x.n", F.round(F.col("x.total") / F.col("x.n"), 6).alias("mean"))


@query(f"with {VOTES} select a, b, count(*) as n, round(avg(answer), 6) as mean from v group by 1, 2")
def ss_suspend(spark: SparkSession, d: str) -> DataFrame:
    """A stream of answers that is stopped after half of its files and goes on from its checkpoint when the rest is there."""
    inbox, out, state = fresh_path(spark, "inbox"), fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    rows = votes(spark, d).select("event_id", F.to_json(F.create_map(F.concat_ws(",", "a", "b"), F.col("answer") == 1)).alias("result"))
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half).write.mode("append").csv(inbox, header=True, quote='"', escape='"')
        done = live.resume(live.votes(live.read(spark, inbox)), spark, out, state)
    return done.groupBy("a", "b").agg(F.max(F.struct("n", "total")).alias("x")).select("a", "b", "x.n", F.round(F.col("x.total") / F.col("x.n"), 6).alias("mean"))


@query("select time_bucket(interval '1 day', ts, timestamp '1970-01-01') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def ss_events(spark: SparkSession, d: str) -> DataFrame:
    """Extension: daily windows of events, as a stream with a watermark, in append mode with a closing row."""
    return live.run_once(live.daily(live.read_events(spark, f"{d}/events.parquet")), spark, "complete").select("day", "event_type", "n", F.round("total", 4).alias("total"))


@query("select user_id, count(*) as n from events where event_type = 'click' group by 1")
def ss_queue_stream(spark: SparkSession, d: str) -> DataFrame:
    """Stream-static anti join: events whose type is closed are dropped."""
    closed = table(spark, d, "events").select("event_type").distinct().where("event_type <> 'click'")
    return live.run_once(live.read_events(spark, f"{d}/events.parquet").join(closed, "event_type", "left_anti").groupBy("user_id").agg(F.count("*").alias("n")), spark, "complete")


@query("select count(*) > 0 as sampled from region")
def ss_sampler(spark: SparkSession, d: str) -> DataFrame:
    return live.sampled(spark, 1).agg((F.count("*") > 0).alias("sampled"))

