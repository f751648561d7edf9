"""Sources and sinks: files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import records as R
from ..sources import tasks as T
from ..sources.shared import fresh_path, stash, written
from .base import EDGES, POSTERIORS, RECORDS, VOTES, edges, posteriors, query, records, table, votes

FIELDS = ["title", "author", "publisher", "pubdate"]
BACK = f"with {RECORDS} select cluster_id, title, author, pubdate, count(*) as n from r group by all"


def counted(df: DataFrame) -> DataFrame:
    return df.select("cluster_id", *(R.field(x).alias(x) for x in ("title", "author", "pubdate"))).groupBy("cluster_id", "title", "author", "pubdate").agg(F.count("*").alias("n"))


@query(f"with {RECORDS} select cast(id as bigint) as idx, cluster_id, title, author from r")
def src_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "records") + ".tsv"
    records(spark, d).orderBy("id").write.csv(path, sep="\t", header=True)
    return R.read_any(spark, path, ["title", "author"], "cluster_id").select("idx", "cluster_id", R.field("title").alias("title"), R.field("author").alias("author"))


@query(BACK, "src_dispatch")
def src_dispatch(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "records") + ".csv"
    records(spark, d).write.csv(path, header=True)
    return counted(R.read_any(spark, path, FIELDS, "cluster_id"))


def yaml_files(df: DataFrame, path: str, version: str) -> None:
    """A YAML document (JSON is a subset of it) for each of some parts of the clusters, in a file of its own."""
    row = F.struct("id", "cluster_id", F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.col(f)))).alias("data")) if version != "2.2" else F.struct("id", F.col("cluster_id").alias("group"), *FIELDS)
    per = df.groupBy("cluster_id").agg(F.collect_list(row).alias("rows"))
    part = per.groupBy(F.pmod(F.hash("cluster_id"), F.lit(4)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "rows"))).alias("records"))
    doc = F.struct(F.lit(version).alias("version"), F.lit("TARGET" if version == "3.1" else "NORMAL").alias("type"), F.col("records").alias("records" if version != "2.2" else "books"))
    part.select("part", F.to_json(doc).alias("value")).write.partitionBy("part").text(path)


@query(BACK)
def src_yaml(spark: SparkSession, d: str) -> DataFrame:
    yaml_files(records(spark, d), path := fresh_path(spark, "records") + ".yaml", "3.1")
    return counted(R.read_any(spark, path))


@query(BACK)
def src_upgrade(spark: SparkSession, d: str) -> DataFrame:
    yaml_files(records(spark, d), path := fresh_path(spark, "records") + ".yml", "2.2")
    return counted(R.read_any(spark, path))


@query(BACK)
def src_flex(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "records") + ".json"
    r = records(spark, d)
    group = F.struct(F.collect_list(F.struct("id", "cluster_id", *FIELDS)).alias("records"))
    halves = r.withColumn("half", F.pmod(F.hash("id"), F.lit(2)))
    a = halves.where("half = 0").groupBy("cluster_id").agg(group.alias("g")).agg(F.to_json(F.struct(F.collect_list("g").alias("group"))).alias("value"))
    b = halves.where("half = 1").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "cluster_id", F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.col(f)))).alias("data"))).alias("records"))).alias("value"))
    a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1))).write.partitionBy("part").text(path)
    return counted(R.read_any(spark, path))


@query(f"with {RECORDS} select cluster_id, count(*) as size, min(id) as first_id, max(id) as last_id from r group by 1")
def src_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("id", F.col("id").alias("idx"), "cluster_id", F.create_map(F.lit("title"), F.col("title")).alias("data"))
    return R.by_cluster(r).select("cluster_id", F.size("records").cast("long").alias("size"), F.col("records")[0]["id"].alias("first_id"), F.element_at("records", -1)["id"].alias("last_id"))


@query(f"with {VOTES} select a, b, answer, count(*) as n from v group by all")
def src_crowd_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "answers")
    key = F.concat_ws(",", "b", "a")
    votes(spark, d).select(F.col("event_id").alias("id"), F.to_json(F.create_map(key, F.col("answer") == 1)).alias("result")).write.csv(path, header=True, quote='"', escape='"')
    return T.read_answers(spark, path).groupBy("a", "b", "answer").agg(F.count("*").alias("n"))


@query(f"with {POSTERIORS} select cast(a as varchar) as a, cast(b as varchar) as b, round(inf_same, 4) as inf_same, round(inf_not, 4) as inf_not from q")
def src_req_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "requests")
    p = posteriors(spark, d).withColumn("at", F.lit(1))
    rows = T.task_rows(p, records(spark, d), ["title"], ["inf_same", "inf_not"])
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    return T.read_requests(spark, path, 1).select("a", "b", F.round("inf_same", 4).alias("inf_same"), F.round("inf_not", 4).alias("inf_not"))


@query(f"""with {VOTES} select cast(a as varchar) as a, cast(b as varchar) as b, arg_max(case when event_id % 3 = 0 then 0.0 else answer / 2.0 end, event_id) as score
from (select least(cast(a as varchar), cast(b as varchar)) as a, greatest(cast(a as varchar), cast(b as varchar)) as b, answer, event_id from v) group by all""")
def src_llm_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "scores")
    score = F.when(F.col("event_id") % 3 == 0, "none").otherwise((F.col("answer") / 2).cast("string"))
    votes(spark, d).select(F.col("b").alias("record_id_1"), F.col("a").alias("record_id_2"), score.alias("score"), F.col("event_id").alias("seq")).write.csv(path, header=True)
    return T.last_scores(spark.read.schema("record_id_1 string, record_id_2 string, score string, seq long").csv(path, header=True))


@query("select c_custkey, md5(c_name) as key, case when c_nationkey < 12 then c_acctbal end as cached, c_nationkey >= 12 as miss from customer")
def src_pickle_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache that is written in two goes, the second correcting the first, and read: hits by left join, misses by anti join."""
    path, c = fresh_path(spark, "cache"), table(spark, d, "customer").where("c_nationkey < 12").withColumn("key", F.md5("c_name"))
    T.save_cache(c.select("key", (F.col("c_acctbal") + 1).alias("value"), F.lit(0).alias("seq")), path)
    T.save_cache(c.select("key", F.col("c_acctbal").alias("value"), F.lit(1).alias("seq")), path)
    wanted = table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("key"))
    hit, miss = T.cache_lookup(wanted, T.load_cache(spark, path).withColumnRenamed("value", "cached"))
    return hit.withColumn("miss", F.lit(False)).unionByName(miss.withColumn("cached", F.lit(None).cast("double")).withColumn("miss", F.lit(True)))


@query("select c_custkey from customer where c_nationkey >= 12")
def jn_cache_miss(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("key"))
    return T.cache_lookup(wanted, table(spark, d, "customer").where("c_nationkey < 12").select(F.md5("c_name").alias("key")))[1].select("c_custkey")


@query("select n_nationkey as a, n_regionkey + 25 as b, 0.5 as score from nation where n_nationkey < 25")
def src_candidates(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "candidates")
    n = table(spark, d, "nation").select(F.array(F.col("n_nationkey").cast("string"), (F.col("n_regionkey") + 25).cast("string")).alias("p"))
    n.agg(F.to_json(F.struct(F.collect_list("p").alias("candidate_pairs"))).alias("value")).write.text(path)
    found = T.read_candidates(spark, path)
    x, y = F.col("a").cast("int"), F.col("b").cast("int")
    return found.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "score")


RESULT = f"""with {RECORDS}, t as (select cluster_id, count(*) as ts from r group by 1)
select label, count(*) as size, min(id) as first_id, min(cluster_id) = max(cluster_id) and max(ts) = count(*) as perfect_match from r join t using (cluster_id) group by label"""


@query(RESULT)
def snk_result(spark: SparkSession, d: str) -> DataFrame:
    return written(R.result_groups(records(spark, d)), "result").select("label", "size", F.col("ids")[0].alias("first_id"), "perfect_match")


@query(f"with {RECORDS} select label, count(*) as size, min(id) as first_id, min(cluster_id) = max(cluster_id) as perfect_match from r group by label")
def snk_result_b(spark: SparkSession, d: str) -> DataFrame:
    return written(R.first_groups(records(spark, d)), "result").select("label", "size", F.col("ids")[0].alias("first_id"), "perfect_match")


@query(f"""with {RECORDS}, c as (select cluster_id, count(*) as n from r group by 1)
select 'records' as part, '' as key, sum(n)::bigint as n from c union all select 'clusters', '', count(*) from c union all select 'size', cast(n as varchar), count(*) from c group by n union all select 'cluster', cluster_id, n from c""")
def snk_yaml_records(spark: SparkSession, d: str) -> DataFrame:
    """A file of the summary and one of the clusters with their records, read back."""
    r = records(spark, d).select("id", F.col("id").alias("idx"), "cluster_id", F.create_map(F.lit("title"), F.col("title")).alias("data"))
    head, clusters = written(R.summary(r), "summary"), written(R.by_cluster(r), "records")
    return head.unionByName(clusters.select(F.lit("cluster").alias("part"), F.col("cluster_id").alias("key"), F.size("records").cast("long").alias("n")))


@query(f"with {RECORDS} select x.label, x.id as id1, y.id as id2, x.title as title1, y.title as title2, x.cluster_id = y.cluster_id as correct from r x join r y on x.label = y.label and x.id < y.id")
def snk_matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    # Columnar: the file grows with the square of a label, and runs of one record take no room in columns.
    return written(R.matched_pairs(records(spark, d), ["title"]).select("label", "id1", "id2", "title1", "title2", "correct"), "pairs", "parquet")


INFO = f"""with {RECORDS}, c as (select author as label, cluster_id, count(*) as n from r group by 1, 2)
select label, cast(sum(n) as bigint) as size, first(cluster_id order by n desc, cluster_id) as majority, round(max(n) / sum(n), 6) as purity from c group by label"""


@query(INFO)
def ag_purity(spark: SparkSession, d: str) -> DataFrame:
    return R.cluster_info(records(spark, d).withColumn("label", F.col("author"))).withColumn("purity", F.round("purity", 6))


@query(INFO)
def snk_cluster_info(spark: SparkSession, d: str) -> DataFrame:
    return written(ag_purity(spark, d), "clusters", "csv")


@query("select p_partkey as id, p_name as title, p_type as cluster_id, p_brand as original_cluster_id, p_type = p_brand as is_correctly_clustered from part")
def snk_record_info(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return written(r.select("id", "title", F.col("author").alias("cluster_id"), F.col("cluster_id").alias("original_cluster_id"), (F.col("author") == F.col("cluster_id")).alias("is_correctly_clustered")), "records", "csv")


TASKS = """select cast(place as bigint) as count, cast(a as varchar) as id1, x.title as title1, cast(b as varchar) as id2, y.title as title2{1}
from (select *, row_number() over (order by {0}, a, b) as place from q) join r x on a = x.id join r y on b = y.id"""


def task_file(spark: SparkSession, d: str, order, more: list[str] = ()) -> DataFrame:
    """All pairs by an order, as a task file that is written and read again."""
    path = fresh_path(spark, "tasks")
    rows = T.task_rows(T.numbered(posteriors(spark, d), order), records(spark, d), ["title"], list(more))
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    back = spark.read.csv(path, header=True, quote='"', escape='"')
    return back.select(F.col("count").cast("long").alias("count"), "id1", "title1", "id2", "title2", *(F.round(F.col(m).cast("double"), 5).alias(m) for m in more))


SETS = f"with {POSTERIORS}, {RECORDS} "
UNCERTAIN, UNKNOWN, RANDOM = "round(0.5 - abs(p - 0.5), 9) desc", "round(1 - (inf_same + inf_not), 9) desc", "md5('42' || ':' || a || ':' || b)"


@query(SETS + TASKS.format("n desc", ""))
def snk_crowd_n4u(spark: SparkSession, d: str) -> DataFrame:
    return task_file(spark, d, F.desc("n"))


@query(SETS + TASKS.format("n desc", ", round(inf_same, 5) as inf_same, round(inf_not, 5) as inf_not"))
def snk_crowd_inf(spark: SparkSession, d: str) -> DataFrame:
    return task_file(spark, d, F.desc("n"), ["inf_same", "inf_not"])


@query(SETS + TASKS.format(UNCERTAIN, ""))
def snk_crowd_uncertain(spark: SparkSession, d: str) -> DataFrame:
    return task_file(spark, d, F.desc(F.round(0.5 - F.abs(F.col("p") - 0.5), 9)))


@query(SETS + TASKS.format(UNKNOWN, ""))
def snk_crowd_unknown(spark: SparkSession, d: str) -> DataFrame:
    return task_file(spark, d, F.desc(F.round(1 - (F.col("inf_same") + F.col("inf_not")), 9)))


@query(SETS + TASKS.format(RANDOM, ""))
def snk_crowd_random(spark: SparkSession, d: str) -> DataFrame:
    return task_file(spark, d, T.random_order("42"))


@query(f"with {POSTERIORS.replace('q as (', 'q as materialized (')}, o as (" + " union all ".join(f"select '{p}' as platform, {n} as file, a, b, row_number() over (order by {order}, a, b) as place from q" for p, n, order in (("N4U", 1, "n desc"), ("EXP_WITH_INF", 1, "n desc"), ("EXP_CIKM2023", 1, "n desc"), ("EXP_CIKM2023", 2, UNCERTAIN), ("EXP_CIKM2023", 3, UNKNOWN), ("EXP_CIKM2023", 4, RANDOM))) + ") select platform, file, count(*) as tasks, sum(place * (a + 3 * b))::bigint as order_sum from o group by 1, 2")
def snk_crowd_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The numbered task files of each platform, read back: how many tasks each has, and a sum that its order fixes."""
    pairs, out = stash(posteriors(spark, d).select("a", "b", "n", "p", "inf_same", "inf_not"), "pairs"), None
    for platform in T.PLATFORMS:
        for number, path in T.dispatch(platform, pairs, fresh_path(spark, "tasks")):
            rows = spark.read.schema("at long, a long, b long").csv(path, header=True).select(F.lit(platform).alias("platform"), F.lit(number).alias("file"), "at", "a", "b")
            out = rows if out is None else out.unionByName(rows)
    return order_sums(out)


def order_sums(rows: DataFrame) -> DataFrame:
    """platform, file, tasks, order_sum of at * (a + 3 b): a long, or a decimal where one doesn't fit in 64 bits."""
    x = F.col("at") * (F.col("a") + 3 * F.col("b"))
    # Halves are added by themselves, as no sum of them can overflow.
    high, low = F.sum(F.shiftright(x, 32)).cast("decimal(20,0)"), F.sum(x.bitwiseAND((1 << 32) - 1)).cast("decimal(20,0)")
    sums = stash(rows.groupBy("platform", "file").agg(F.count("*").alias("tasks"), (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(38,0)").alias("order_sum")), "sums")
    most = sums.agg(F.max(F.abs("order_sum"))).first()[0]
    return sums if most is not None and most >= 1 << 63 else sums.withColumn("order_sum", F.col("order_sum").cast("long"))


@query(f"with {EDGES} select a as task, b, truth from e")
def snk_answers_sim(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    sheet = T.answer_sheet(e.select(F.col("a").alias("task"), "a", "b"), e.where("truth"))
    return sheet.select(F.col("id").alias("task"), F.explode(F.from_json("result", "map<string, boolean>")).alias("key", "truth")).select("task", T.split_pair(F.col("key"))["b"].alias("b"), "truth")


@query(f"with {EDGES}, {RECORDS} select a, b, round(p, 6) as similarity, x.title as title1, y.title as title2, x.author as author1, y.author as author2, x.cluster_id as c1, y.cluster_id as c2 from e join r x on a = x.id join r y on b = y.id")
def snk_similarities_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "similarities")
    r = records(spark, d)
    side = lambda x, n: r.select(F.col("id").alias(x), F.col("title").alias(f"title{n}"), F.col("author").alias(f"author{n}"), F.col("cluster_id").alias(f"c{n}"))
    rows = edges(spark, d).select("a", "b", F.round("p", 6).alias("similarity")).join(side("a", 1), "a").join(side("b", 2), "b")
    rows.orderBy(F.desc("similarity"), "a", "b").write.csv(path, header=True, quoteAll=True, escape='"')
    return spark.read.schema(rows.schema).csv(path, header=True, quote='"', escape='"')


@query(f"with {EDGES} select row_number() over (order by round(p, 6) desc, md5(a || ':' || b)) as place, md5(a || ':' || b) as key, round(p, 6) as similarity from e")
def snk_cache_dump(spark: SparkSession, d: str) -> DataFrame:
    """The score cache (key: md5 of the sorted pair) as a file by falling similarity."""
    path = fresh_path(spark, "cache")
    T.save_cache(edges(spark, d).select(F.md5(F.concat_ws(":", F.least("a", "b"), F.greatest("a", "b"))).alias("key"), F.round("p", 6).alias("value"), F.lit(0).alias("seq")), path)
    dump = R.dense_index(T.load_cache(spark, path).orderBy(F.desc("value"), "key"), "place")
    return written(dump.select((F.col("place") + 1).alias("place"), "key", F.col("value").alias("similarity")), "dump", "csv")


@query(f"with {EDGES} select a, b, truth from e where (p >= 0.5) <> truth")
def snk_jsonl_ft(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "finetune")
    rows = edges(spark, d).select(F.concat_ws(",", "a", "b").alias("prompt"), (F.col("p") >= 0.5).alias("model"), "truth")
    T.finetune_lines(rows).write.text(path)
    m = spark.read.schema("messages array<struct<role string, content string>>").json(path)
    pair = T.split_pair(F.col("messages")[0]["content"])
    return m.select(pair["a"].alias("a"), pair["b"].alias("b"), (F.col("messages")[1]["content"] == "はい").alias("truth"))


@query(f"with {EDGES} select a, b, n, round(p, 6) as p, truth from e")
def snk_suspend(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "state")
    T.save_state({"edges": edges(spark, d), "answers": votes(spark, d)}, {"index": 3}, path)
    tables, _ = T.load_state(spark, path)
    return tables["edges"].select("a", "b", "n", F.round("p", 6).alias("p"), "truth")


@query(f"with {EDGES} select a, b, round(p, 6) as p from e union all select p_partkey, null, null from part")
def snk_graph_file(spark: SparkSession, d: str) -> DataFrame:
    """A graph saved and loaded: its edges, and its vertices (b is null), those without an edge too."""
    path = fresh_path(spark, "graph")
    T.save_graph(edges(spark, d).select("a", "b", F.round("p", 6).alias("p")), table(spark, d, "part").select(F.col("p_partkey").alias("id")), path)
    e, v = T.load_graph(spark, path)
    return e.unionByName(v.select(F.col("id").alias("a")), allowMissingColumns=True)


@query(f"with {EDGES}, {RECORDS} select a, b, x.title as title1, y.title as title2, round(p, 6) as p from e join r x on a = x.id join r y on b = y.id where p >= 0.85 and not truth")
def snk_misident(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    wrong = edges(spark, d).where("p >= 0.85 and not truth")
    found = wrong.join(r.select(F.col("id").alias("a"), F.col("title").alias("title1")), "a").join(r.select(F.col("id").alias("b"), F.col("title").alias("title2")), "b")
    return written(found.select("a", "b", "title1", "title2", F.round("p", 6).alias("p")), "wrong")


@query("with c as (select user_id, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2) select user_id, event_type, n, mean, row_number() over (partition by user_id order by event_type) as iteration from c")
def snk_iter_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "iterations")
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    from pyspark.sql import Window

    rows = c.withColumn("iteration", F.row_number().over(Window.partitionBy("user_id").orderBy("event_type")))
    rows.write.mode("append").csv(path, header=True)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query()
def src_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return R.benchmark_slices(records(spark, d), 7).select("id", "cluster_id", "slice")


@query(f"with {RECORDS} select id, cluster_id, row_number() over (order by id) - 1 as idx from r")
def src_construct(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_index(records(spark, d).select("id", "cluster_id").orderBy("id"))


@query(f"""with {RECORDS}, c as (select cluster_id, count(*) as n, md5('42' || ':' || cluster_id) as h from r group by 1),
big as (select cluster_id, 60 as k from c where n >= 60 order by h, cluster_id limit 3),
small as (select cluster_id, 5 as k from c where n >= 5 and cluster_id not in (select cluster_id from big) order by h, cluster_id limit 4),
s as (select id, r.cluster_id, k, row_number() over (partition by r.cluster_id order by md5('42' || ':' || id), id) as rank from r join (select * from big union all select * from small) using (cluster_id))
select id, cluster_id from s where rank <= k""")
def src_sample_clusters(spark: SparkSession, d: str) -> DataFrame:
    return R.sample_clusters(records(spark, d), {5: 4, 60: 3}).select("id", "cluster_id")


@query("""with n as (select row_number() over (order by n_nationkey) - 1 as b, n_name as t from nation)
select b || '-' || v as id, cast(b as varchar) as cluster_id, case v when 0 then t when 1 then upper(t) else t || ' ' end as title from n, (select unnest(range(3)) as v)
union all select b || '-decoy', b || '-decoy', t || ' (続)' from n""")
def src_synth(spark: SparkSession, d: str) -> DataFrame:
    names = [r["n_name"] for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    return R.synthetic(spark, [{"title": n} for n in names], 3).select("id", "cluster_id", R.field("title").alias("title"))


@query(f"with {RECORDS}, c as (select cluster_id, count(*) as n from r group by 1) select count(*) as clusters, cast(sum(n) as bigint) as records, min(n) as least, max(n) as most, round(avg(n), 6) as mean from c")
def src_inspect(spark: SparkSession, d: str) -> DataFrame:
    return R.profile(records(spark, d))


@query("select '3.2' as version, 'gamma' as type, event_type as indicator, round(avg(value) * avg(value) / var_pop(value), 6) as alpha, round(avg(value) / var_pop(value), 6) as beta from events group by event_type")
def src_params(spark: SparkSession, d: str) -> DataFrame:
    """Parameters fitted by moments, an entry for each indicator with its family and the file's version, saved and loaded."""
    m, v = F.avg("value"), F.var_pop("value")
    fitted = table(spark, d, "events").groupBy("event_type").agg(F.round(m * m / v, 6).alias("alpha"), F.round(m / v, 6).alias("beta"))
    return written(fitted.select(F.lit("3.2").alias("version"), F.lit("gamma").alias("type"), F.col("event_type").alias("indicator"), "alpha", "beta"), "params")


@query(f"with {EDGES}, a as (select distinct a, b from e where n > 1) select a, b from e anti join a using (a, b)", "ss_queue")
def ss_queue(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return T.open_tasks(e.select("a", "b"), e.where("n > 1"))

