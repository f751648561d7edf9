"""What the queries share: a registry, tables in the roles of records, pairs and votes, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unit_hash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Registers a function (spark, sf_dir) under its name (or names) with its SQL."""

    def register(f):
        for name in names or (f.__name__,):
            QUERIES[name] = f
            if sql:
                SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records: id, title, author, publisher, pubdate, cluster_id (true group), label (predicted group)."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("author"), F.col("p_brand").alias("publisher"),
        (F.col("p_size") + 1990).cast("string").alias("pubdate"), F.col("p_brand").alias("cluster_id"), F.concat_ws("/", "p_type", F.lower("p_brand")).alias("label"),
    )


RECORDS = "r as (select p_partkey as id, p_name as title, p_type as author, p_brand as publisher, cast(p_size + 1990 as varchar) as pubdate, p_brand as cluster_id, p_type || '/' || lower(p_brand) as label from part)"


def unit_sql(seed: str, *parts: str) -> str:
    joined = " || ':' || ".join([f"'{seed}'", *parts])
    return f"(('0x' || substr(md5({joined}), 1, 8))::bigint / 4294967296.0)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts that were ordered together: a, b, n (orders), p (a probability by hash), truth (same brand)."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    met = line.select("l_orderkey", F.col("l_partkey").alias("a")).join(line.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    brand = lambda x: table(spark, d, "part").select(F.col("p_partkey").alias(x), F.col("p_brand").alias(f"brand_{x}"))
    p = unit_hash("7", F.col("a").cast("string"), F.col("b").cast("string"))
    return met.join(brand("a"), "a").join(brand("b"), "b").select("a", "b", "n", p.alias("p"), (F.col("brand_a") == F.col("brand_b")).alias("truth"))


EDGES = f"""l as materialized (select distinct l_orderkey as o, l_partkey as k from lineitem),
e as materialized (
  select a, b, n, {unit_sql('7', 'a', 'b')} as p, x.p_brand = y.p_brand as truth
  from (select x.k as a, y.k as b, count(*) as n from l x join l y on x.o = y.o and x.k < y.k group by 1, 2) join part x on a = x.p_partkey join part y on b = y.p_partkey)"""

#: Pairs count as matches from here; about one edge in seven.
TAU = 0.85


def matches(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where(F.col("p") >= TAU)


MATCHES = f"{EDGES},\nm as materialized (select a, b, p from e where p >= {TAU})"
BOTH = "s as (select a as u, b as v, p from m union all select b, a, p from m)"


def posteriors(spark: SparkSession, d: str) -> DataFrame:
    """edges with inf_same, inf_not, inf_unknown that add up to one."""
    q = unit_hash("9", F.col("a").cast("string"), F.col("b").cast("string"))
    return edges(spark, d).withColumn("inf_same", F.col("p")).withColumn("inf_not", (1 - F.col("p")) * q).withColumn("inf_unknown", 1 - F.col("inf_same") - F.col("inf_not"))


POSTERIORS = f"{EDGES},\nq as (select a, b, n, p, truth, p as inf_same, (1 - p) * {unit_sql('9', 'a', 'b')} as inf_not, 1 - p - (1 - p) * {unit_sql('9', 'a', 'b')} as inf_unknown from e)"


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Events as answers: a, b (users, by the hour of the event), answer."""
    e = table(spark, d, "events")
    other = (F.col("user_id") * 7 + F.col("event_id") % 5) % 150
    return e.select(F.least("user_id", other).alias("a"), F.greatest("user_id", other).alias("b"), F.when(F.col("value") >= 20, 1).otherwise(0).alias("answer"), "event_id").where("a <> b")


VOTES = "v as (select * from (select least(user_id, (user_id * 7 + event_id % 5) % 150) as a, greatest(user_id, (user_id * 7 + event_id % 5) % 150) as b, case when value >= 20 then 1 else 0 end as answer, event_id from events) where a <> b)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


VECTORS = "x as (select vec_id as id, list_transform(embedding, lambda z: z::double) as vector, label from embeddings)"
COS = "list_cosine_similarity({0}, {1})"
L2 = "list_distance({0}, {1})"
