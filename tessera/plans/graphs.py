"""Graph and clustering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators import pairs as P
from ..sources.shared import stash
from .base import EDGES, L2, MATCHES, POSTERIORS, RECORDS, VECTORS, edges, matches, posteriors, query, records, table, vectors
from .pairing import components_sql


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"))


@query("select p_partkey as id, p_partkey as label from part")
def gr_init(spark: SparkSession, d: str) -> DataFrame:
    return vertices(spark, d).select("id", F.col("id").alias("label"))


@query(f"with {EDGES} select a, b from e where truth union select a, b from e where n > 1")
def gr_connect(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return P.canonical(e.where("truth").unionByName(e.where("n > 1")))


@query(f"with {EDGES} select a, b from e")
def gr_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.both_ways(edges(spark, d)).where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))


@query(f"with {MATCHES} select a as id from m union select b from m")
def gr_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.both_ways(matches(spark, d)).select(F.col("u").alias("id")).distinct()


@query(f"with {EDGES} select a, b from e where not truth")
def gr_remove(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return e.select("a", "b").join(e.where("truth").select("a", "b"), ["a", "b"], "left_anti")


@query(f"with {EDGES} select distinct least(a - a % 4, b - b % 4) as a, greatest(a - a % 4, b - b % 4) as b from e where a - a % 4 <> b - b % 4")
def gr_contract(spark: SparkSession, d: str) -> DataFrame:
    return graph.contracted(edges(spark, d), vertices(spark, d).select("id", (F.col("id") - F.col("id") % 4).alias("label")))


@query(f"with {RECORDS} select id from r where label = 'ECONOMY/brand#2'")
def gr_members(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("label = 'ECONOMY/brand#2'").select("id")


@query(f"with {EDGES} select count(*) filter (p >= 0.85) as found, count(*) as total, round(count(*) filter (p >= 0.85) / count(*), 6) as recall from e where truth")
def gr_recall(spark: SparkSession, d: str) -> DataFrame:
    return graph.recall(matches(spark, d), edges(spark, d).where("truth").select("a", "b"))


POTENTIAL = f"with recursive {EDGES}, g as (select a, b from e where truth and p >= 0.5), {components_sql('g')}"


@query(f"{POTENTIAL} select count(*) filter (x.component = y.component) as found, count(*) as total, round(count(*) filter (x.component = y.component) / count(*), 6) as recall from e left join n x on a = x.node left join n y on b = y.node where truth")
def gr_potential_recall(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    truth = e.where("truth").select("a", "b")
    return graph.recall(graph.potential_pairs(e.where("p >= 0.5"), truth), truth)


@query(f"with recursive {EDGES}, g as (select a, b from e where truth and p >= 0.5), {components_sql('g')} select * from n")
def gr_cc(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(edges(spark, d).where("truth and p >= 0.5"))


KNN = f"with {VECTORS}, y as (select i.id as src, j.id as nbr, {L2.format('i.vector', 'j.vector')} as dist from x i join x j on i.id <> j.id), z as (select *, row_number() over (partition by src order by dist, nbr) as rank from y)"


@query(f"{KNN} select distinct least(src, nbr) as a, greatest(src, nbr) as b from z where rank <= 10")
def gr_knn(spark: SparkSession, d: str) -> DataFrame:
    return P.canonical(P.vector_pairs(vectors(spark, d), "l2", most=10), "src", "nbr")


@query()
def gr_diversity(spark: SparkSession, d: str) -> DataFrame:
    return graph.diverse_neighbours(vectors(spark, d), 1.1).select("src", "nbr", F.round("dist", 6).alias("dist"))


@query()
def gr_div_compressed(spark: SparkSession, d: str) -> DataFrame:
    return graph.compressed_neighbours(vectors(spark, d), 1.0)


@query()
def gr_synergy(spark: SparkSession, d: str) -> DataFrame:
    return graph.synergy_edges(vectors(spark, d), 1.0).select("a", "b", F.round("dist", 6).alias("dist"))


@query(f"with recursive {EDGES}, g as (select a, b from e where case when n > 1 then truth else p >= 0.995 end), {components_sql('g')} select id as node, coalesce(component, id) as label from (select distinct unnest([a, b]) as id from e) left join n on id = node")
def gr_contract_all(spark: SparkSession, d: str) -> DataFrame:
    """The whole graph contracted until no edge is left: answered pairs (n > 1) by their answer, others by inference."""
    e = stash(edges(spark, d), "edges")
    return graph.contract_all(e, e.where("if(n > 1, truth, p >= 0.995)"))


@query(f"""with {POSTERIORS}, k as (select *, row_number() over (partition by inf_same > 0.5 or inf_not > 0.5 order by inf_unknown, a, b) as k from q)
select a, b, case when inf_same > 0.5 then 'same' when inf_not > 0.5 then 'not' when k <= 1000 then 'asked' when inf_same >= inf_not then 'same' else 'not' end as decision from k""")
def gr_contract_limited(spark: SparkSession, d: str) -> DataFrame:
    return graph.contract_limited(posteriors(spark, d), 1000)


@query()
def gr_greedy_star(spark: SparkSession, d: str) -> DataFrame:
    scored = edges(spark, d).where("truth").select("a", "b", F.col("p").alias("emb"), F.col("p").alias("score"))
    return graph.leader_clusters(scored, vertices(spark, d), 0.5)


@query(f"with recursive {EDGES}, g as (select a, b from e where truth and p >= 0.9), {components_sql('g')} select node as id, component as label from n")
def gr_merge_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_chain(edges(spark, d).where("truth").select("a", "b", F.col("p").alias("score")), 0.9)


@query()
def gr_merge_matching(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_matching(edges(spark, d).select("a", "b", F.round("p", 6).alias("score"))).select("a", "b", "score")


@query()
def gr_adaptive(spark: SparkSession, d: str) -> DataFrame:
    from .workflow import adaptive_merge

    r = records(spark, d)
    scored = stash(edges(spark, d).select("a", "b", F.col("p").alias("score")), "scores")
    return adaptive_merge(r.select("id", "cluster_id"), scored)


@query(f"with recursive {EDGES}, g as (select distinct x.p_name as a, y.p_name as b from e join part x on e.a = x.p_partkey join part y on e.b = y.p_partkey where e.truth and e.p >= 0.99 and x.p_name <> y.p_name), {components_sql('g')} select p_name as cluster, coalesce(component, p_name) as merged from (select distinct p_name from part) left join n on p_name = node")
def gr_update_clusters(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_partkey", "p_name")
    at = lambda x: names.select(F.col("p_partkey").alias(x), F.col("p_name").alias(f"n{x}"))
    links = edges(spark, d).where("truth and p >= 0.99").join(at("a"), "a").join(at("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return graph.labels(names.select(F.col("p_name").alias("id")).distinct(), links).select(F.col("id").alias("cluster"), F.col("label").alias("merged"))


@query(f"{KNN} select distinct least(src, nbr) as a, greatest(src, nbr) as b from y where dist <= 1.1")
def gr_deemed(spark: SparkSession, d: str) -> DataFrame:
    return P.canonical(P.vector_pairs(vectors(spark, d), "l2", within=1.1), "src", "nbr")


@query(f"{KNN} select least(src, nbr) as a, greatest(src, nbr) as b, round(min(dist), 6) as dist from z where rank <= 5 group by 1, 2")
def gr_reflect(spark: SparkSession, d: str) -> DataFrame:
    """Distances of saved edges computed anew; the edges stay as they are."""
    saved = stash(P.canonical(P.vector_pairs(vectors(spark, d), "l2", most=5), "src", "nbr"), "saved")
    from ..functions.similarity import l2

    at = lambda x, v: vectors(spark, d).select(F.col("id").alias(x), F.col("vector").alias(v))
    return saved.join(at("a", "u"), "a").join(at("b", "v"), "b").select("a", "b", F.round(l2(F.col("u"), F.col("v")), 6).alias("dist"))


@query(f"with recursive {EDGES}, g as (select a, b from e where n > 1 and p >= 0.5 and truth), {components_sql('g')} select p_partkey as id, coalesce(component, p_partkey) as label from part left join n on p_partkey = node")
def gr_apply_answers(spark: SparkSession, d: str) -> DataFrame:
    answered = edges(spark, d).where("n > 1 and truth").groupBy("a", "b").agg(F.avg("p").alias("mean")).where("mean >= 0.5")
    return graph.labels(vertices(spark, d), answered)


def linked_sql(pairs: str, x: str) -> str:
    """components_sql under names that end in x."""
    return components_sql(pairs).replace("w(node", f"w{x}(node").replace("select w.node", f"select w{x}.node").replace("from w join", f"from w{x} join").replace("on w.other", f"on w{x}.other").replace("n as (", f"n{x} as (").replace("from w group", f"from w{x} group")


@query(f"""with recursive {EDGES}, g1 as (select a, b from e where truth and p >= 0.85), g2 as (select a, b from e where truth and (p >= 0.85 or n > 1)), {linked_sql('g1', '1')}, {linked_sql('g2', '2')},
z as (select distinct unnest([a, b]) as id from e where p >= 0.85)
select (select count(*) from z) as vertices, count(*) filter (p >= 0.85) as edges, round(count(*) filter (truth and p >= 0.85) / count(*) filter (truth), 6) as recall, round(count(*) filter (truth and (p >= 0.85 or n > 1)) / count(*) filter (truth), 6) as recall_deemed,
  round(count(*) filter (truth and u.component = v.component) / count(*) filter (truth), 6) as potential, round(count(*) filter (truth and s.component = t.component) / count(*) filter (truth), 6) as potential_deemed
from e left join n1 u on a = u.node left join n1 v on b = v.node left join n2 s on a = s.node left join n2 t on b = t.node""")
def gr_summary(spark: SparkSession, d: str) -> DataFrame:
    """Vertices, edges, recall and potential recall, without and with pairs deemed to match by answers."""
    e = stash(edges(spark, d), "edges")
    truth, m = e.where("truth").select("a", "b"), e.where("p >= 0.85").select("a", "b")
    deemed = m.unionByName(e.where("truth and n > 1").select("a", "b")).distinct()
    rate = lambda pairs, name: graph.recall(pairs, truth).select(F.col("recall").alias(name))
    # One row each.
    out = m.agg(F.count("*").alias("edges")).join(graph.both_ways(m).agg(F.countDistinct("u").alias("vertices"))).join(rate(m, "recall")).join(rate(deemed, "recall_deemed"))
    out = out.join(rate(graph.potential_pairs(m, truth), "potential")).join(rate(graph.potential_pairs(deemed, truth), "potential_deemed"))
    return out.select("vertices", "edges", "recall", "recall_deemed", "potential", "potential_deemed")
