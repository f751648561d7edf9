"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import evaluate
from .base import COS, EDGES, L2, POSTERIORS, RECORDS, VECTORS, edges, posteriors, query, records, table, vectors

#: Text columns with brackets and separators, the same in both engines.
TITLES = "t as (select p_partkey as id, p_name || ' [' || p_type || ' (' || p_size || ')]' as title, p_brand || '/著 ' || p_name as author, 'Tokyo : ' || p_brand || ', ' || p_type || ' (x)' as publisher, 'c' || (p_size + 1990) || '.' || (p_size % 12 + 1) as pubdate from part)"


def titles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" ["), "p_type", F.lit(" ("), "p_size", F.lit(")]")).alias("title"), F.concat("p_brand", F.lit("/著 "), "p_name").alias("author"),
        F.concat(F.lit("Tokyo : "), "p_brand", F.lit(", "), "p_type", F.lit(" (x)")).alias("publisher"), F.concat(F.lit("c"), F.col("p_size") + 1990, F.lit("."), F.col("p_size") % 12 + 1).alias("pubdate"),
    )


@query("select column_name as field, role from (values ('p_title', 'TEXT'), ('p_author', 'COMPLEMENT_JA'), ('pubdate', 'DATE'), ('publisher', 'TEXT'), ('isbn', 'TEXT')) t(column_name, role)")
def prj_roles(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("p_title",), ("p_author",), ("pubdate",), ("publisher",), ("isbn",)], "field string")
    return names.select("field", X.field_role(F.col("field")).alias("role"))


@query("select p_partkey as id, case when p_size % 2 = 0 then p_name else p_brand end as title, p_brand as last_title, p_type as author, p_brand as publisher, case when p_size % 3 = 0 then cast(p_size as varchar) end as date from part")
def prj_key_fields(spark: SparkSession, d: str) -> DataFrame:
    """The first field of a record for each role, by field names and types; a title also by the last one."""
    p = table(spark, d, "part")
    text = lambda name, value: (F.lit(name), value.cast("string"))
    data = F.create_map(*text("MainTitle", F.when(F.col("p_size") % 2 == 0, F.col("p_name"))), *text("title2", F.col("p_brand")), *text("author", F.col("p_type")), *text("publisher", F.col("p_brand")), *text("pubdate", F.when(F.col("p_size") % 3 == 0, F.col("p_size"))))
    data = F.map_filter(data, lambda k, v: v.isNotNull())
    first, last = X.key_fields(data), X.key_fields(data, last=True)
    return p.select(F.col("p_partkey").alias("id"), first["title"].alias("title"), last["title"].alias("last_title"), first["author"].alias("author"), first["publisher"].alias("publisher"), first["date"].alias("date"))


@query(f"with {TITLES} select id, title || author || regexp_replace(sha256(pubdate), '[^0-9]', '', 'g') as text from t")
def prj_concat(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("id", F.concat(F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")), X.date_digits(F.col("pubdate"))).alias("text"))


@query(f"with {TITLES} select id, 'title: ' || title || ' title: ' || title || ' title: ' || title || ' author: ' || author || ' author: ' || author || ' pubdate: ' || pubdate as text from t")
def prj_weighted_text(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("id", X.weighted_text({f: F.col(f) for f in ("title", "author", "pubdate")}).alias("text"))


@query(f"with {TITLES} select id, 'タイトル: ' || title || chr(10) || '著者: ' || author || chr(10) || '出版日: ' || pubdate || chr(10) || 'id: ' || id as text from t")
def prj_llm_text(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("id", X.prompt_text({"title": F.col("title"), "author": F.col("author"), "id": F.col("id").cast("string"), "pubdate": F.col("pubdate")}).alias("text"))


@query()
def prj_impute(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    empty = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), *(X.impute(F.lit(r), empty, F.col("p_partkey").cast("string"), F.lit(r)).alias(r.lower()) for r in ("COMPLEMENT_JA", "COMPLEMENT_ASCII", "COMPLEMENT_DATE")))


@query("select c_custkey, lower(regexp_replace(c_name, '[^0-9A-Za-z ]', '', 'g')) as text from customer")
def prj_norm_jp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", X.norm_words(F.col("c_name")).alias("text"))


@query(r"select page_id, trim(regexp_replace(regexp_replace(url || '  [x] {y}', '[\[\](){}]', ' ', 'g'), '\s+', ' ', 'g')) as text from pages")
def prj_norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.norm_spaces(F.concat("url", F.lit("  [x] {y}"))).alias("text"))


NORM = {
    "title": r"trim(regexp_replace(regexp_replace(title, '\s*[\[(].*?[\])]\s*$', ''), '\s+', ' ', 'g'))",
    "author": r"regexp_replace(regexp_replace(regexp_replace(author, '/[著作編訳監].*?$', ''), '[\[(].*?[\])]', '', 'g'), '[\s/,]', '', 'g')",
    "publisher": r"regexp_replace(regexp_replace(regexp_replace(publisher, '^.*?:', ''), '[\[(].*?[\])]', '', 'g'), '[\s/,]', '', 'g')",
    "pubdate": r"regexp_extract(pubdate, '\d{4}')",
}


@query(f"with {TITLES} select id, {NORM['title']} as title from t")
def prj_norm_title(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("id", X.norm_title(F.col("title")).alias("title"))


@query(f"with {TITLES} select id, {NORM['author']} as author from t")
def prj_norm_author(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("id", X.norm_author(F.col("author")).alias("author"))


@query(f"with {TITLES} select id, {NORM['pubdate']} as year from t")
def prj_norm_date(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("id", X.norm_date(F.col("pubdate")).alias("year"))


@query(f"with {TITLES} select id, {NORM['publisher']} as publisher from t")
def prj_norm_publisher(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("id", X.norm_publisher(F.col("publisher")).alias("publisher"))


@query(f"with {TITLES} select id, {NORM['title']} as title, {NORM['author']} as author, {NORM['publisher']} as publisher, {NORM['pubdate']} as pubdate from t")
def prj_norm_record(spark: SparkSession, d: str) -> DataFrame:
    data = F.create_map(*(x for f in NORM for x in (F.lit(f), F.col(f))))
    done = titles(spark, d).select("id", F.transform_values(data, X.norm_field).alias("data"))
    return done.select("id", *(F.col("data")[f].alias(f) for f in NORM))


@query(r"select o_orderkey, nullif(regexp_extract(cast(o_orderdate as varchar), '(19|20)\d{2}'), '') as year from orders")
def prj_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.year(F.col("o_orderdate").cast("string")).alias("year"))


@query(rf"with {TITLES} select id, trim(regexp_extract(title, '^([^(\[{{]+)', 1)) as main_title, title as full_title, nullif(regexp_extract(pubdate, '(19|20)\d{{2}}'), '') as year, array_to_string(regexp_extract_all(title, '(\d+)', 1), ',') as volumes from t")
def prj_features(spark: SparkSession, d: str) -> DataFrame:
    t = titles(spark, d)
    return t.select("id", X.main_title(F.col("title")).alias("main_title"), F.col("title").alias("full_title"), X.year(F.col("pubdate")).alias("year"), F.array_join(X.volume_numbers(F.col("title")), ",").alias("volumes"))


@query("select p_partkey as id, p_name from part where contains(lower(p_name), 'ring') or contains(lower(p_brand), '#17')")
def flt_search(spark: SparkSession, d: str) -> DataFrame:
    data = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    hit = lambda key, word: F.lower(data[key]).contains(word)
    return table(spark, d, "part").where(hit("name", "ring") | hit("brand", "#17")).select(F.col("p_partkey").alias("id"), "p_name")


@query("with a as (select p_name, count(*) as n1 from part where p_brand = 'Brand#2' group by 1), b as (select p_name, count(*) as n2 from part where p_brand = 'Brand#17' group by 1) select coalesce(a.p_name, b.p_name) as p_name, n1, n2 from a full join b on a.p_name = b.p_name")
def flt_cluster(spark: SparkSession, d: str) -> DataFrame:
    one = lambda brand, name: table(spark, d, "part").where(F.col("p_brand") == brand).groupBy("p_name").agg(F.count("*").alias(name))
    return one("Brand#2", "n1").join(one("Brand#17", "n2"), "p_name", "full")


@query(f"with {EDGES} select a, b, round(p, 6) as p from e where p >= 0.7")
def flt_threshold(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("p >= 0.7").select("a", "b", F.round("p", 6).alias("p"))


@query(f"with {EDGES} select a, b, case when p >= 0.8 then 'accept' when p <= 0.3 then 'reject' when (a + b) % 2 = 0 then 'accept' else 'reject' end as decision from e")
def flt_band(spark: SparkSession, d: str) -> DataFrame:
    """The costly scorer sees the middle band alone: the plan is split, not a condition around a function."""
    e = edges(spark, d).select("a", "b", "p")
    sure = e.where("p >= 0.8 or p <= 0.3").select("a", "b", F.when(F.col("p") >= 0.8, "accept").otherwise("reject").alias("decision"))
    middle = e.where("p < 0.8 and p > 0.3").select("a", "b", F.when((F.col("a") + F.col("b")) % 2 == 0, "accept").otherwise("reject").alias("decision"))
    return sure.unionByName(middle)


WORDS = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda t: t <> ''))"
OVERLAP = "len(list_intersect({0}, {1})) / greatest(len({0}), len({1}))"
PRE = f"""case when lower(x.title) = lower(y.title) then 5.0 when contains(lower(y.title), lower(x.title)) or contains(lower(x.title), lower(y.title)) then 3.5
  else 5.0 * {OVERLAP.format(WORDS.format('x.title'), WORDS.format('y.title'))} end"""


@query(f"""with {EDGES}, {RECORDS}, f as (select a, b, round((({PRE}) + 3.0 * case when x.author = y.author then 1 else 0 end + case when x.publisher = y.publisher then 1 else 0 end + case when x.pubdate = y.pubdate then 1 else 0 end) / 10, 6) as score
from e join r x on a = x.id join r y on b = y.id) select a, b, score from f where score >= 0.5""")
def flt_prefilter(spark: SparkSession, d: str) -> DataFrame:
    fields = ("title", "author", "publisher", "pubdate")
    side = lambda x: records(spark, d).select(F.col("id").alias(x), *(F.col(f).alias(f"{f}_{x}") for f in fields))
    both = edges(spark, d).select("a", "b").join(side("a"), "a").join(side("b"), "b")
    names = {"title": "title", "author": "author", "publisher": "publisher", "date": "pubdate"}
    return both.select("a", "b", F.round(S.prefilter({k: F.col(f"{f}_a") for k, f in names.items()}, {k: F.col(f"{f}_b") for k, f in names.items()}), 6).alias("score")).where("score >= 0.5")


@query(f"with {EDGES}, {RECORDS} select a, b from e join r x on a = x.id join r y on b = y.id where not (x.title = y.title and x.author = y.author)")
def flt_exact_dup(spark: SparkSession, d: str) -> DataFrame:
    side = lambda x: records(spark, d).select(F.col("id").alias(x), F.struct("title", "author").alias(f"s{x}"))
    return edges(spark, d).join(side("a"), "a").join(side("b"), "b").where("sa <> sb").select("a", "b")


@query(f"with {EDGES} select a, b from e where truth")
def prd_same_cluster(spark: SparkSession, d: str) -> DataFrame:
    side = lambda x: records(spark, d).select(F.col("id").alias(x), F.col("cluster_id").alias(f"c{x}"))
    return edges(spark, d).select("a", "b").join(side("a"), "a").join(side("b"), "b").where("ca <> '' and ca = cb").select("a", "b")


CLASS = "case when 1 - inf_same < 0.3 then 'SAME' when 1 - inf_not < 0.5 then 'NOT_SAME' else 'UNKNOWN' end"


def classified(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.inference import sun_class

    return posteriors(spark, d).withColumn("decision", sun_class(F.col("inf_same"), F.col("inf_not"), 0.3, 0.5))


@query(f"with {POSTERIORS} select a, b, {CLASS} as decision from q")
def prd_sun_class(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("a", "b", "decision")


@query(f"""with {POSTERIORS}, c as (select a, b, truth, {CLASS} as decision from q)
select a, b, case when decision = 'UNKNOWN' then case when truth then 'UNKNOWN_MATCH' else 'UNKNOWN_MISMATCH' end when decision = 'SAME' then case when truth then 'TP' else 'FP' end else case when truth then 'FN' else 'TN' end end as outcome from c""")
def prd_label6(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("a", "b", evaluate.label6(F.col("truth"), F.col("decision")).alias("outcome"))


NAMES = "n as (select distinct p_name as name from part), y as (select a.name as a, b.name as b from n a join n b on a.name < b.name)"


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct part names: scores of strings are computed once for each pair of strings."""
    n = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    return n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))


@query(f"with {NAMES} select a, b, round(levenshtein(a, b) / (length(a) + length(b)), 6) as distance from y")
def fn_lev_norm(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", F.round(S.lev_norm(F.col("a"), F.col("b")), 6).alias("distance"))


@query(f"with {NAMES} select a, b, round(jaro_winkler_similarity(a, b), 6) as score from y")
def fn_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", F.round(S.jaro_winkler("a", "b"), 6).alias("score"))


@query()
def fn_difflib(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", F.round(S.difflib_ratio("a", "b"), 6).alias("score"))


@query(f"""with {EDGES}, {RECORDS} select a, b, round((0.6 * jaro_winkler_similarity(x.title, y.title) + 0.3 * jaro_winkler_similarity(x.author, y.author) + 0.05 * jaro_winkler_similarity(x.publisher, y.publisher) + 0.05 * jaro_winkler_similarity(x.pubdate, y.pubdate)) / 1.0, 6) as score
from e join r x on a = x.id join r y on b = y.id""", "fn_weighted_jw")
def fn_weighted_jw(spark: SparkSession, d: str) -> DataFrame:
    return weighted_jw(edges(spark, d).select("a", "b"), records(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


def weighted_jw(pairs: DataFrame, r: DataFrame) -> DataFrame:
    """pairs with score. Each field's distinct pairs of strings are scored once and joined back."""
    fields = {"title": "title", "author": "author", "publisher": "publisher", "date": "pubdate"}
    side = lambda x: r.select(F.col("id").alias(x), *(F.col(f).alias(f"{k}_{x}") for k, f in fields.items()))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    for k in fields:
        x, y = f"{k}_a", f"{k}_b"
        score = both.select(x, y).distinct().withColumn(f"{k}_score", S.jaro_winkler(x, y))
        both = both.join(score, [x, y])
    full = {k: (F.col(f"{k}_a") != "") & (F.col(f"{k}_b") != "") for k in fields}
    return both.withColumn("score", S.weighted({k: F.col(f"{k}_score") for k in fields}, full, 0.0))


@query()
def fn_hybrid(spark: SparkSession, d: str) -> DataFrame:
    p = name_pairs(spark, d).withColumn("r", S.difflib_ratio("a", "b"))
    return p.select("a", "b", F.round(S.hybrid(S.char_jaccard(F.col("a"), F.col("b")), F.col("r"), F.col("r")), 6).alias("score"))


@query(f"with {NAMES} select a, b, round({OVERLAP.format(WORDS.format('a'), WORDS.format('b'))}, 6) as score from y")
def fn_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", F.round(S.token_overlap(X.tokens(F.col("a")), X.tokens(F.col("b"))), 6).alias("score"))


CHARS = "list_distinct(string_split({0}, ''))"


@query(f"with {NAMES}, c as (select a, b, {CHARS.format('a')} as x, {CHARS.format('b')} as z from y) select a, b, round(len(list_intersect(x, z)) / (len(x) + len(z) - len(list_intersect(x, z))), 6) as score from c")
def fn_char_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", F.round(S.char_jaccard(F.col("a"), F.col("b")), 6).alias("score"))


@query(f"""with {EDGES}, g as (select a, b, abs(x.p_size - y.p_size) as d, a % 11 = 0 as missing from e join part x on a = x.p_partkey join part y on b = y.p_partkey)
select a, b, case when missing then 0.5 when d = 0 then 1.0 when d <= 1 then 0.9 when d <= 2 then 0.8 when d <= 5 then 0.7 when d <= 10 then 0.5 else 0.3 end::double as score from g""")
def fn_year_sim(spark: SparkSession, d: str) -> DataFrame:
    side = lambda x: records(spark, d).select(F.col("id").alias(x), F.when((F.lit(x) != "a") | (F.col("id") % 11 != 0), X.year(F.col("pubdate"))).alias(f"y{x}"))
    both = edges(spark, d).select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", S.year_similarity(F.col("ya"), F.col("yb")).alias("score"))


NEXT = "w as (select i.id, i.vector as u, j.vector as v from x i join x j on j.id = i.id + 1)"


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with that of the next id."""
    x = vectors(spark, d)
    return x.select("id", F.col("vector").alias("u")).join(x.select((F.col("id") - 1).alias("id"), F.col("vector").alias("v")), "id")


@query(f"with {VECTORS}, {NEXT} select id, round({COS.format('u', 'v')}, 6) as score from w")
def fn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d).select("id", F.round(S.cosine(F.col("u"), F.col("v")), 6).alias("score"))


@query(f"with {VECTORS}, {NEXT} select id, round((1 - {COS.format('u', 'v')}) * 10, 6) as score from w")
def fn_cos_dist10(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d).select("id", F.round((1 - S.cosine(F.col("u"), F.col("v"))) * 10, 6).alias("score"))


@query(f"with {VECTORS}, {NEXT} select id, round({L2.format('u', 'v')}, 6) as score from w")
def fn_l2(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d).select("id", F.round(S.l2(F.col("u"), F.col("v")), 6).alias("score"))


@query(f"with {VECTORS} select id, round(vector[1] / sqrt(list_inner_product(vector, vector)), 6) as first, round(vector[64] / sqrt(list_inner_product(vector, vector)), 6) as last from x")
def fn_l2norm(spark: SparkSession, d: str) -> DataFrame:
    n = vectors(spark, d).select("id", S.l2_normalised(F.col("vector")).alias("n"))
    return n.select("id", F.round(F.col("n")[0], 6).alias("first"), F.round(F.col("n")[63], 6).alias("last"))


@query("select o_orderkey, regexp_replace(sha256(o_orderpriority || o_orderkey), '[^0-9]', '', 'g') as digits from orders")
def fn_date_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.date_digits(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("digits"))


@query("select p_partkey as id, 10 as ones, length(cast(p_partkey + 1000000000 as varchar)) as n from part")
def fn_onehot_date(spark: SparkSession, d: str) -> DataFrame:
    hot = table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.onehot_digits((F.col("p_partkey") + 1000000000).cast("string")).alias("v"))
    return hot.select("id", F.size(F.filter("v", lambda x: x > 0)).alias("ones"), F.round(1 / F.pow(F.array_max("v"), 2)).cast("long").alias("n"))


@query("select p_partkey as id, len(list_distinct(list_filter(string_split(p_name, ' '), lambda t: t <> ''))) as n, list_aggregate(list_distinct(string_split(p_name, ' ')), 'min') as first from part")
def fn_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.tokens(F.col("p_name")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.array_min("t").alias("first"))


@query("select p_partkey as id, len(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3)))) as n from part")
def fn_shingles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(X.shingles(F.col("p_name"))).cast("long").alias("n"))


@query()
def fn_embed_sim(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.embedding import pseudo_embedding

    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", pseudo_embedding("name").alias("vector"))


@query(f"with {EDGES} select a, b, md5(a || ':' || b) as key from e")
def fn_pair_key(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("a", "b", F.md5(F.concat_ws(":", F.least("a", "b"), F.greatest("a", "b"))).alias("key"))


ANSWERS = "select event_id, case event_id % 5 when 0 then 'score ' || (event_id % 1000) / 1000.0 when 1 then '1' when 2 then 'none' when 3 then '類似度: ' || (event_id % 1000) / 1000.0 || chr(10) || 'x' else 'similarity ' || event_id % 7 end as t from events"


def answers(spark: SparkSession, d: str) -> DataFrame:
    k1, k = F.col("event_id") % 1000, F.col("event_id") % 5
    t = (
        F.when(k == 0, F.concat(F.lit("score "), (k1 / 1000.0).cast("string"))).when(k == 1, "1").when(k == 2, "none")
        .when(k == 3, F.concat(F.lit("類似度: "), (k1 / 1000.0).cast("string"), F.lit("\nx"))).otherwise(F.concat(F.lit("similarity "), (F.col("event_id") % 7).cast("string")))
    )
    return table(spark, d, "events").select("event_id", t.alias("t"))


@query(rf"with t as ({ANSWERS}) select event_id, greatest(0.0, least(1.0, coalesce(try_cast(nullif(regexp_extract(t, '0\.\d+|\d+\.0|[01]'), '') as double), 0.5))) as score from t")
def fn_parse_score(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("event_id", X.parse_score(F.col("t")).alias("score"))


@query(r"""select event_id, case event_id % 2 when 0 then 'はい' else 'いいえ' end as verdict, (event_id % 1000) / 1000.0 as score, 'k ' || user_id as reason from events""")
def fn_parse_verdict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = F.concat(F.when(F.col("event_id") % 2 == 0, "はい。\n").otherwise("いいえ\n"), F.lit("類似度スコア: "), (F.col("event_id") % 1000 / 1000.0).cast("string"), F.lit("\n理由: k "), F.col("user_id").cast("string"))
    return e.select("event_id", X.parse_verdict(t).alias("v")).select("event_id", "v.verdict", "v.score", "v.reason")


@query("select n_nationkey as id, n_name as name from nation")
def fn_repair_json(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    broken = F.concat(F.lit("```json\n{'id': "), F.col("n_nationkey").cast("string"), F.lit(",\n'name': '"), "n_name", F.lit("',}\n```"))
    return n.select(F.from_json(X.repair_json(broken), "id int, name string").alias("j")).select("j.*")


@query("select event_id, user_id as pair_first, (user_id + 1) as pair_second, value as score from events")
def fn_json_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    reply = F.to_json(F.struct(F.array(F.struct(F.array(F.lit(1), F.lit(2)).alias("pair"), F.col("value").alias("score"))).alias("similarity_pairs")))
    parsed = e.select("event_id", "user_id", F.explode(F.from_json(reply, "similarity_pairs array<struct<pair array<int>, score double, reason string>>")["similarity_pairs"]).alias("p"))
    return parsed.select("event_id", (F.col("user_id") + F.col("p.pair")[0] - 1).alias("pair_first"), (F.col("user_id") + F.col("p.pair")[1] - 1).alias("pair_second"), "p.score")


@query("select o_orderkey, o_orderkey * 1234567 // 86400000 as d, o_orderkey * 1234567 // 3600000 % 24 as h, o_orderkey * 1234567 // 60000 % 60 as m, o_orderkey * 1234567 // 1000 % 60 as s, o_orderkey * 1234567 % 1000 as ms from orders")
def fn_duration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.duration(F.col("o_orderkey") * 1234567).alias("x")).select("o_orderkey", "x.*")


@query(f"""with {EDGES} select a, b, '・' || case when p > 0.8 then 'タイトルが非常に類似しています（類似度: ' || printf('%.2f', p) || '）' when p > 0.6 then 'タイトルに一定の類似性があります（類似度: ' || printf('%.2f', p) || '）' else '全体的な特徴の組み合わせから同じ本と判断できます' end as reason from e""")
def fn_reason(spark: SparkSession, d: str) -> DataFrame:
    low = F.lit(0.5)
    return edges(spark, d).select("a", "b", S.reasons(F.col("p"), low, low, low, F.lit(True)).alias("reason"))
