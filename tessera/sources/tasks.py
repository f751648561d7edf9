"""Pairs, review tasks, answers, scores, caches, parameters, graphs and saved state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .records import dense_index


def split_pair(key: Column) -> Column:
    """(a, b) with a < b of a key "i,j"."""
    ends = F.transform(F.split(key, ","), lambda x: F.trim(x).cast("long"))
    return F.struct(F.least(ends[0], ends[1]).alias("a"), F.greatest(ends[0], ends[1]).alias("b"))


def answers_of(rows: DataFrame, result: str = "result") -> DataFrame:
    """a, b, answer (1 or 0) of rows whose column `result` is JSON {"i,j": true or false}; works on streams too."""
    pairs = rows.select(F.explode(F.from_json(result, "map<string, boolean>")).alias("key", "same"))
    return pairs.select(split_pair(F.col("key")).alias("p"), F.col("same").cast("int").alias("answer")).select("p.a", "p.b", "answer")


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    return answers_of(spark.read.csv(folder, header=True, quote='"', escape='"', multiLine=True))


def open_tasks(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """Tasks of the queue (a, b) without an answer."""
    return queue.join(answers.select("a", "b").distinct(), ["a", "b"], "left_anti")


def read_requests(spark: SparkSession, path: str, attributes: int) -> DataFrame:
    """a, b, inf_same, inf_not of a task file: ids at a stride of attributes + 1, the last two columns probabilities."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    c = rows.columns
    return rows.select(F.col(f"`{c[1]}`").alias("a"), F.col(f"`{c[2 + attributes]}`").alias("b"), F.col(f"`{c[-2]}`").cast("double").alias("inf_same"), F.col(f"`{c[-1]}`").cast("double").alias("inf_not"))


def last_scores(rows: DataFrame) -> DataFrame:
    """a, b, score from record_id_1, record_id_2, score (text), seq: missing or "none" is 0, the last of a pair counts."""
    score = F.coalesce(F.expr("try_cast(score as double)"), F.lit(0.0))
    pair = rows.select(F.least("record_id_1", "record_id_2").alias("a"), F.greatest("record_id_1", "record_id_2").alias("b"), score.alias("score"), "seq")
    return pair.groupBy("a", "b").agg(F.max_by("score", "seq").alias("score"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """a, b, score of JSON with candidate_pairs (score 0.5) or record_pairs."""
    doc = spark.read.schema("candidate_pairs array<array<string>>, record_pairs array<array<string>>").json(path, multiLine=True)
    pair = doc.select(F.explode(F.coalesce("record_pairs", "candidate_pairs")).alias("x"))
    return pair.select(F.least(F.col("x")[0], F.col("x")[1]).alias("a"), F.greatest(F.col("x")[0], F.col("x")[1]).alias("b"), F.coalesce(F.try_element_at("x", F.lit(3)).cast("double"), F.lit(0.5)).alias("score"))


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Hits (wanted with the cached value) and misses."""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")


def save_cache(rows: DataFrame, path: str) -> None:
    """Adds rows (key, value, seq) to a cache table; the last of a key counts."""
    rows.write.mode("append").parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, value."""
    return spark.read.parquet(path).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


# The orders of tasks that each platform gets, a file each.
PLATFORMS = {"N4U": ("n4u",), "EXP_WITH_INF": ("inference",), "EXP_CIKM2023": ("inference", "uncertainty", "unknown", "random")}


def dispatch(platform: str, pairs: DataFrame, path: str) -> list[tuple[int, str]]:
    """Task files of a platform, numbered from 1: (number, folder). pairs: a, b, n, p, inf_same, inf_not."""
    orders = {
        "n4u": F.desc("n"), "inference": F.desc("n"), "uncertainty": F.desc(F.round(0.5 - F.abs(F.col("p") - 0.5), 9)),
        "unknown": F.desc(F.round(1 - (F.col("inf_same") + F.col("inf_not")), 9)), "random": random_order("42"),
    }
    out = []
    for number, order in enumerate(PLATFORMS[platform], 1):
        # Only the ends go on after the sort.
        places = dense_index(pairs.orderBy(orders[order], "a", "b").select("a", "b"), "at")
        places.select((F.col("at") + 1).alias("at"), "a", "b").write.csv(name := f"{path}/{platform}-{number:04d}", header=True)
        out.append((number, name))
    return out


def task_rows(pairs: DataFrame, records: DataFrame, attributes: list[str], more: list[str] = ()) -> DataFrame:
    """count, id1, attributes of it, id2, attributes of it, and further columns of pairs (a, b, at)."""
    side = lambda n, key: records.select(F.col("id").alias(key), F.col("id").cast("string").alias(f"id{n}"), *(F.col(x).alias(f"{x}{n}") for x in attributes))
    joined = pairs.join(side(1, "a"), "a").join(side(2, "b"), "b")
    return joined.select(F.col("at").alias("count"), "id1", *(f"{x}1" for x in attributes), "id2", *(f"{x}2" for x in attributes), *more)


def numbered(pairs: DataFrame, *order: Column) -> DataFrame:
    """pairs with at, from 1 in the order given and then by a and b; a range sort, so that no task holds all."""
    return dense_index(pairs.orderBy(*order, "a", "b"), "at").withColumn("at", F.col("at") + 1)


def uncertain_first(p: Column) -> Column:
    return F.desc(0.5 - F.abs(p - 0.5))


def unknown_first(same: Column, no: Column) -> Column:
    return F.desc(1 - (same + no))


def random_order(seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), "a", "b"))


def answer_sheet(tasks: DataFrame, truth: DataFrame) -> DataFrame:
    """id, result: for each task (task, a, b) the JSON of the true answers (truth: a, b of matches)."""
    told = tasks.join(truth.select("a", "b", F.lit(True).alias("same")), ["a", "b"], "left")
    entry = F.struct(F.concat_ws(",", "a", "b").alias("key"), F.coalesce("same", F.lit(False)).alias("same"))
    return told.groupBy("task").agg(F.array_sort(F.collect_list(entry)).alias("e")).select(F.col("task").alias("id"), F.to_json(F.map_from_entries("e")).alias("result"))


def finetune_lines(rows: DataFrame) -> DataFrame:
    """value: a JSON line of messages for each row (prompt, model, truth: booleans) that the model got wrong."""
    word = F.when(F.col("truth"), "はい").otherwise("いいえ")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), word.alias("content")))
    return rows.where(F.col("model") != F.col("truth")).select(F.to_json(F.struct(messages.alias("messages"))).alias("value"))


def save_graph(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    edges.write.parquet(f"{path}/edges")
    vertices.write.parquet(f"{path}/vertices")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/vertices")


def save_state(tables: dict[str, DataFrame], manifest: dict, path: str) -> None:
    """Workflow state: a Parquet table for each name and a JSON manifest, written last."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in (manifest | {"tables": ",".join(sorted(tables))}).items()], "key string, value string").coalesce(1).write.json(f"{path}/manifest")


def load_state(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{path}/manifest").collect()}
    return {n: spark.read.parquet(f"{path}/{n}") for n in manifest.pop("tables").split(",")}, manifest
