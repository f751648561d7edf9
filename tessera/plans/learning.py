"""Inference, consistency, active learning, human review and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import unit_hash
from ..operators import active, embedding, evaluate, graph
from ..operators import consistency as C
from ..operators import inference as I
from ..operators import pairs as P
from ..sources.records import dense_index
from ..sources.shared import stash
from .base import BOTH, EDGES, L2, MATCHES, POSTERIORS, RECORDS, VECTORS, VOTES, edges, matches, posteriors, query, records, table, unit_sql, vectors, votes
from .graphs import POTENTIAL
from .pairing import components_sql
from .scalar import CLASS, classified

# Fixed parameters of the example: mean, variance, weight of each indicator for matches and mismatches.
SAME = ((0.2, 0.02, 1.0), (0.8, 0.03, 1.0), (0.15, 0.02, 1.0), (0.85, 0.02, 1.0))
NOT = ((0.7, 0.04, 1.0), (0.3, 0.05, 1.0), (0.45, 0.03, 1.0), (0.5, 0.05, 1.0))


def indicators(spark: SparkSession, d: str) -> DataFrame:
    """edges with four indicators by hash and their densities for matches (s0..s3) and mismatches (n0..n3)."""
    e = edges(spark, d)
    x = [unit_hash(str(20 + i), F.col("a").cast("string"), F.col("b").cast("string")) for i in range(4)]
    e = e.withColumns({f"x{i}": c for i, c in enumerate(x)})
    return e.withColumns({f"s{i}": I.mixture_pdf(F.col(f"x{i}"), [SAME[i]]) for i in range(4)} | {f"n{i}": I.mixture_pdf(F.col(f"x{i}"), [NOT[i]]) for i in range(4)})


def pdf_sql(x: str, part: tuple[float, float, float]) -> str:
    return f"greatest(1e-6, exp(-(({x}) - {part[0]}) * (({x}) - {part[0]}) / (2 * {part[1]})) * ({part[2]} / sqrt(2 * pi() * {part[1]})))"


DENSITIES = (
    EDGES
    + ",\nh as (select *, " + ", ".join(f"{unit_sql(str(20 + i), 'a', 'b')} as x{i}" for i in range(4)) + " from e),\n"
    + "f as (select *, " + ", ".join(f"{pdf_sql(f'x{i}', SAME[i])} as s{i}, {pdf_sql(f'x{i}', NOT[i])} as n{i}" for i in range(4)) + " from h)"
)
PS, PN = "s0 * s1 * s2 * s3", "n0 * n1 * n2 * n3"
S4, N4 = [F"s{i}" for i in range(4)], [f"n{i}" for i in range(4)]


def cols(names: list[str]) -> list:
    return [F.col(n) for n in names]


@query(f"""with {DENSITIES} select a, b, round(s0, 6) as s0, round(n3, 6) as n3,
  round(greatest(1e-6, case when x1 > 0 and x1 < 1 then exp(lgamma(5.5) - lgamma(2.0) - lgamma(3.5) + ln(x1) + 2.5 * ln(1 - x1)) else 0 end), 6) as beta,
  round(greatest(1e-6, case when x2 > 0.05 then exp(1.5 * ln(4.0) - lgamma(1.5) + 0.5 * ln(x2 - 0.05) - 4.0 * (x2 - 0.05)) else 0 end), 6) as gamma from f""")
def in_pdf(spark: SparkSession, d: str) -> DataFrame:
    """Densities of the three families."""
    families = {"beta": (F.col("x1"), {"type": "beta", "alpha": 2.0, "beta": 3.5}), "gamma": (F.col("x2"), {"type": "gamma", "alpha": 1.5, "beta": 4.0, "loc": 0.05}), "s0": (F.col("x0"), {"type": "mixture", "parts": [SAME[0]]}), "n3": (F.col("x3"), {"type": "mixture", "parts": [NOT[3]]})}
    return indicators(spark, d).select("a", "b", *(F.round(I.density(x, family), 6).alias(name) for name, (x, family) in families.items()))


@query(f"with {DENSITIES} select a, b, round({PS} * 0.1 / greatest({PS} * 0.1 + {PN} * 0.9, 1e-4), 6) as p, round(1 - ({PS} + {PN}) / ((s0 + n0) * (s1 + n1) * (s2 + n2) * (s3 + n3)), 6) as unknown from f", "in_bayes", "in_pairwise_all")
def in_bayes(spark: SparkSession, d: str) -> DataFrame:
    p, unknown = I.bayes(cols(S4), cols(N4))
    return indicators(spark, d).select("a", "b", F.round(p, 6).alias("p"), F.round(unknown, 6).alias("unknown"))


SUN = f"{DENSITIES}, g as (select a, b, truth, " + ", ".join(f"s{i} / (s{i} + n{i}) as p{i}" for i in range(4)) + " from f)"


@query(f"with {SUN} select a, b, round(p1 * p2 * p3, 6) as p_same, round((1 - p1) * (1 - p2) * (1 - p3), 6) as p_not, round(1 - p1 * p2 * p3 - (1 - p1) * (1 - p2) * (1 - p3), 6) as unknown from g")
def in_sun(spark: SparkSession, d: str) -> DataFrame:
    same, no, rest = I.sun(cols(S4), cols(N4))
    return indicators(spark, d).select("a", "b", F.round(same, 6).alias("p_same"), F.round(no, 6).alias("p_not"), F.round(rest, 6).alias("unknown"))


BEST = " * ".join(f"greatest(p{i}, 1 - p{i})" for i in range(4))
CELL = "[" + ", ".join(f"case when {BEST} <= 0.5 then -1 when p{i} > 0.5 then 1 else 0 end" for i in range(4)) + "]"


@query(f"with {SUN} select a, b, array_to_string({CELL}, ',') as cell from g")
def in_majority_cell(spark: SparkSession, d: str) -> DataFrame:
    return indicators(spark, d).select("a", "b", F.concat_ws(",", I.majority_cell(cols(S4), cols(N4)).cast("array<string>")).alias("cell"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = indicators(spark, d)
    return e.select(F.when(F.col("truth"), "match").otherwise("mismatch").alias("label"), F.explode(F.array(*(F.struct(F.lit(n).alias("indicator"), F.col(f"x{i}").alias("x")) for i, n in enumerate(I.INDICATORS)))).alias("y")).select("y.indicator", "label", "y.x")


@query()
def in_fit(spark: SparkSession, d: str) -> DataFrame:
    return I.fit(samples(spark, d), {"vector": "beta", "leven": "beta", "difflib": "gamma", "jaro": "mixture"})


@query()
def in_regen(spark: SparkSession, d: str) -> DataFrame:
    families = {"vector": "beta", "leven": "beta", "difflib": "gamma", "jaro": "gamma"}
    return I.fit(I.regenerate(I.fit(samples(spark, d), families)), families)


@query(f"with {SUN}, c as (select array_to_string([" + ", ".join(f"case when p{i} > 0.5 then 1 else 0 end" for i in range(4)) + "], ',') as cell, truth from g), k as (select cell, avg(case when truth then 1.0 else 0.0 end) as m from c group by 1) select cell, case when 1 - m < 0.4 then 'SAME' when m < 0.4 then 'NOT' else 'UNKNOWN' end as region from k")
def in_sun_regions(spark: SparkSession, d: str) -> DataFrame:
    bits = [F.when(F.col(s) / (F.col(s) + F.col(n)) > 0.5, "1").otherwise("0") for s, n in zip(S4, N4, strict=True)]
    return I.learned_regions(indicators(spark, d).select(F.concat_ws(",", *bits).alias("cell"), F.col("truth").alias("match")))


@query(f"""with {EDGES}, {RECORDS}, o as (select least(x.author, y.author) as ca, greatest(x.author, y.author) as cb, p, row_number() over (partition by least(x.author, y.author), greatest(x.author, y.author) order by md5('42' || ':' || a || ':' || b)) as k from e join r x on a = x.id join r y on b = y.id),
t as (select distinct author as t from r) select x.t as ca, y.t as cb, round(coalesce(avg(p), 10.0), 6) as dist from t x join t y on x.t < y.t left join o on o.ca = x.t and o.cb = y.t and k <= 5 group by 1, 2""")
def in_cluster_dist(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    t = r.select("author").distinct()
    wanted = t.select(F.col("author").alias("ca")).join(t.select(F.col("author").alias("cb")), F.col("ca") < F.col("cb"))
    return I.cluster_distance(wanted, r.select("id", F.col("author").alias("label")), edges(spark, d).select("a", "b", F.col("p").alias("dist"))).select("ca", "cb", F.round("dist", 6).alias("dist"))


@query(f"with {EDGES} select round(avg(case when truth then p * p else power(greatest(0, 1 - p), 2) end), 6) as loss from e")
def in_contrastive_loss(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).agg(F.round(F.avg(I.contrastive_loss(F.col("p"), F.col("truth"))), 6).alias("loss"))


@query()
def in_embed_train(spark: SparkSession, d: str) -> DataFrame:
    """A projection learnt from pairs of vectors (same label: a match), and every vector mapped by it."""
    v = vectors(spark, d)
    pairs = v.select("id", F.col("vector").alias("u"), F.col("label").alias("l")).join(v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("v"), F.col("label").alias("m")), "id").select("u", "v", (F.col("l") == F.col("m")).alias("match"))
    return embedding.project(v.select("id", "vector"), embedding.fit_projection(pairs)).select("id", "vector")


@query()
def in_label_soft(spark: SparkSession, d: str) -> DataFrame:
    from .scalar import name_pairs

    p = name_pairs(spark, d).withColumn("r", S.difflib_ratio("a", "b"))
    return p.select("a", "b", F.round(I.soft_label(F.substring_index("a", " ", 1) == F.substring_index("b", " ", 1), F.col("r")), 6).alias("label"))


@query(f"with {EDGES}, k as (select a, b, truth, row_number() over (partition by truth order by a, b) as k, count(*) over (partition by truth) as n from e) select a, b, truth, case when k <= floor(n * 0.8) then 'train' else 'test' end as part from k")
def in_split(spark: SparkSession, d: str) -> DataFrame:
    # Places in one range sort; of each kind only the count is needed (two rows).
    k = dense_index(edges(spark, d).orderBy("truth", "a", "b").select("a", "b", "truth"), "k")
    sizes = k.groupBy("truth").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    train = F.col("k") - F.col("first") + 1 <= F.floor(F.col("n") * 0.8)
    return k.join(F.broadcast(sizes), "truth").select("a", "b", "truth", F.when(train, "train").otherwise("test").alias("part"))


# Consistency

MISSING = f"""with {MATCHES}, {BOTH}, o as (select x.u as a, x.v as hub, y.v as c, least(x.p, y.p) as t from s x join s y on x.v = y.u and x.u <> y.v anti join s z on z.u = x.u and z.v = y.v)"""


@query(f"{MISSING} select a, c, hub, round(t, 6) as transitive, round((t - 0.85) / 0.15, 6) as confidence from o where t > 0.9")
def cs_missing_edge(spark: SparkSession, d: str) -> DataFrame:
    m = C.missing_edges(edges(spark, d), 0.85)
    return m.select("a", "c", "hub", F.round("transitive", 6).alias("transitive"), F.round("confidence", 6).alias("confidence"))


@query(f"{MISSING}, x as (select a, c as b, max(t) as t from o where t > 0.9 and a < c group by 1, 2) select coalesce(x.a, e.a) as a, coalesce(x.b, e.b) as b, round(coalesce(t, p), 6) as p from e full join x on e.a = x.a and e.b = x.b")
def cs_resolve(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return C.resolved(e.select("a", "b", "p"), C.missing_edges(e, 0.85)).select("a", "b", F.round("p", 6).alias("p"))


@query(f"with {EDGES}, {RECORDS}, w as (select x.label, count(*) as pairs, avg(case when p >= 0.5 then 1.0 else 0.0 end) as c from e join r x on a = x.id join r y on b = y.id and x.label = y.label group by 1) select l.label, coalesce(pairs, 0) as pairs, coalesce(round(c, 6), 1.0)::double as consistency from (select distinct label from r) l left join w on l.label = w.label")
def cs_cluster_consistency(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster_consistency(edges(spark, d), records(spark, d).select("id", "label"), 0.5)


@query(f"with {MATCHES}, {BOTH}, z as (select a as u, b as v from e where p < 0.85 union all select b, a from e where p < 0.85) select x.u as a, x.v as b, y.v as c from s x join s y on x.v = y.u join z on z.u = x.u and z.v = y.v")
def cs_violations(spark: SparkSession, d: str) -> DataFrame:
    return C.violations(edges(spark, d), 0.85)


TRIPLETS = f"{MATCHES}, t as (select x.a, x.b, y.b as c, round(x.p * y.p * (1 - coalesce(e.p, 0.5)), 9) as score from m x join m y on x.b = y.a left join e on e.a = x.a and e.b = y.b where coalesce(e.p, 0) < 0.85)"


def triplets(spark: SparkSession, d: str) -> DataFrame:
    return C.triplets(edges(spark, d), 0.85).withColumn("score", F.round("score", 9))


@query(f"with {TRIPLETS} select a, b, c, score from t")
def cs_triplets(spark: SparkSession, d: str) -> DataFrame:
    return triplets(spark, d)


TRIANGLES = f"{MATCHES}, t as (select x.a, x.b, y.b as c, x.p as pab, y.p as pbc, z.p as pac, round(x.p * y.p * (1 - z.p) + y.p * z.p * (1 - x.p) + z.p * x.p * (1 - y.p), 9) as score from m x join m y on x.b = y.a join m z on z.a = x.a and z.b = y.b)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return C.scored_triangles(matches(spark, d)).withColumn("score", F.round("score", 9))


@query(f"with {TRIANGLES} select a, b, c, score from t")
def cs_triangles(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("a", "b", "c", "score")


@query(f"""with {POSTERIORS}, k as (select a, b, case when 1 - inf_same < 0.3 then 1 when 1 - inf_not < 0.5 then 100 else 10 end as k from q where n > 1 or p >= 0.8),
t as (select x.a, x.b, y.b as c, x.k + y.k + z.k as code from k x join k y on x.b = y.a join k z on z.a = x.a and z.b = y.b) select a, b, c, code, code in (102, 12, 111, 21, 120, 30) as inconsistent from t""")
def cs_axiom_class(spark: SparkSession, d: str) -> DataFrame:
    k = classified(spark, d).where("n > 1 or p >= 0.8").select("a", "b", "decision")
    side = lambda x, y, n: k.select(F.col("a").alias(x), F.col("b").alias(y), F.col("decision").alias(n))
    t = graph.triangles(k).join(side("a", "b", "x"), ["a", "b"]).join(side("b", "c", "y"), ["b", "c"]).join(side("a", "c", "z"), ["a", "c"])
    code = C.axiom_code(F.col("x"), F.col("y"), F.col("z"))
    return t.select("a", "b", "c", code.alias("code"), C.inconsistent(code).alias("inconsistent"))


@query(f"with {TRIANGLES}, g as (select a, b, score from t union all select b, c, score from t union all select a, c, score from t) select a, b, max(score) as score from g group by 1, 2")
def ag_triplet_max(spark: SparkSession, d: str) -> DataFrame:
    return active.three_pairs(scored(spark, d).select("a", "b", "c", "score")).groupBy("a", "b").agg(F.max("score").alias("score"))


# Active learning

THREE = "g as (select t.*, 0 as place, a as x, b as y from t union all select t.*, 1, b, c from t union all select t.*, 2, a, c from t)"
CORE = f"""with {TRIPLETS}, {THREE}, u as (select g.*, round(abs(coalesce(e.p, 0.5) - 0.5), 9) as u from g left join e on e.a = x and e.b = y),
one as (select *, row_number() over (partition by a, b, c order by u, place) as k from u), f as (select *, row_number() over (partition by x, y order by score desc, a, b, c) as k2 from one where k = 1)
select x as a, y as b, u as uncertainty, score from f where k2 = 1 order by u, x, y limit 300"""


@query(CORE)
def al_core_inconsistency(spark: SparkSession, d: str) -> DataFrame:
    return active.core_pairs(triplets(spark, d), edges(spark, d), 300)


@query(f"with {TRIPLETS}, v as (select * from t order by score desc, a, b, c limit 100), {THREE.replace('from t', 'from v').replace('t.*', 'v.*')}, f as (select x, y, score, a, b, c, place, row_number() over (partition by x, y order by score desc, a, b, c, place) as k from g) select x as a, y as b, score from f where k = 1 order by score desc, a, b, c, place limit 300")
def al_inconsistency(spark: SparkSession, d: str) -> DataFrame:
    return active.triplet_pairs(triplets(spark, d), 300)


@query(f"with {EDGES} select a, b, round(abs(p - 0.5), 9) as uncertainty from e order by uncertainty, a, b limit 300")
def al_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return active.uncertain(edges(spark, d), 300).select("a", "b", "uncertainty")


REVIEWED = "e as (select a, b, n, case when n > 1 or (a + b) % 40 > 0 then case when truth then 1.0::double else 0.0::double end else p end as p, truth from e0)"


F1_SQL = """f as (select count(*) filter (p >= 0.5 and truth) as tp, count(*) filter (p >= 0.5 and not truth) as fp, count(*) filter (p < 0.5 and truth) as fn from e), f1 as (select round(2 * tp / (2 * tp + fp + fn), 6) as f1 from f)"""


@query(f"""with {EDGES.replace('e as materialized (', 'e0 as materialized (')}, {REVIEWED}, {F1_SQL}, m as (select a, b, p from e where p >= 0.85), t as (select x.a, x.b, y.b as c, round(x.p * y.p * (1 - coalesce(e.p, 0.5)), 9) as score from m x join m y on x.b = y.a left join e on e.a = x.a and e.b = y.b where coalesce(e.p, 0) < 0.85), {THREE}, u as (select g.*, round(abs(coalesce(e.p, 0.5) - 0.5), 9) as u from g left join e on e.a = x and e.b = y),
one as (select *, row_number() over (partition by a, b, c order by u, place) as k from u), w as (select *, row_number() over (partition by x, y order by score desc, a, b, c) as k2 from one where k = 1),
core as (select x as a, y as b, u as uncertainty from w where k2 = 1 order by u, x, y limit 300), near as (select a, b, round(abs(p - 0.5), 9) as uncertainty from e0 order by uncertainty, a, b limit 300),
f0 as (select round(2 * count(*) filter (p >= 0.5 and truth) / (2 * count(*) filter (p >= 0.5 and truth) + count(*) filter (p >= 0.5 and not truth) + count(*) filter (p < 0.5 and truth)), 6) as f1 from e0)
select 'before' as state, near.* from near, f0 where f1 < 0.75 union all select 'after', core.* from core, f1 where f1 >= 0.75""")
def al_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Uncertainty while F1 is under 0.75, then the core of inconsistency: before and after most pairs were reviewed."""
    e = stash(edges(spark, d), "edges")
    told = F.when((F.col("n") > 1) | ((F.col("a") + F.col("b")) % 40 > 0), F.col("truth").cast("double")).otherwise(F.col("p"))
    out = None
    for state, scores in (("before", e), ("after", stash(e.withColumn("p", told), "reviewed"))):
        f = evaluate.with_scores(evaluate.confusion(scores.withColumn("predicted", F.col("p") >= 0.5))).first()["f1"]
        t = C.triplets(scores, 0.85).withColumn("score", F.round("score", 9))
        part = active.hybrid(f, t, scores, 300).select(F.lit(state).alias("state"), "a", "b", "uncertainty")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"with {POSTERIORS} select a, b, round(inf_unknown, 6) as unknown from q order by inf_unknown desc, a, b limit 300")
def al_qbc(spark: SparkSession, d: str) -> DataFrame:
    return active.most_unknown(posteriors(spark, d), 300).select("a", "b", F.round("inf_unknown", 6).alias("unknown"))


MIDPOINTS = f"""{EDGES}, {VECTORS}, y as (select e.a, e.b, n > 1 as answered, list_transform(range(1, 65), lambda i: (u.vector[i] + w.vector[i]) / 2) as v from e join x u on e.a = u.id join x w on e.b = w.id),
near as (select p.a, p.b, count(q.a) as near from (select * from y where not answered) p left join (select * from y where answered) q on {L2.format('p.v', 'q.v')} <= 0.8 group by 1, 2)"""


@query(f"with {MIDPOINTS} select a, b, near from near order by near, a, b limit 300")
def al_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Pending pairs that are near no answered one first, then those near few: distances between midpoints of the pairs' vectors."""
    at = lambda x: vectors(spark, d).select(F.col("id").alias(x), F.col("vector").alias(f"v{x}"))
    pairs = edges(spark, d).join(at("a"), "a").join(at("b"), "b").select("a", "b", (F.col("n") > 1).alias("answered"), F.zip_with("va", "vb", lambda x, y: (x + y) / 2).alias("vector"))
    pairs = stash(dense_index(pairs, "id"), "midpoints")
    near = P.vector_pairs(pairs.select("id", "vector"), "l2", within=0.8)
    pending, answered = pairs.where(~F.col("answered")).select(F.col("id").alias("src"), "a", "b"), pairs.where("answered").select(F.col("id").alias("nbr"))
    return active.diversity(pending.select("a", "b"), near.join(answered, "nbr").join(pending, "src").select("a", "b"), 300).select("a", "b", "near")


@query(f"with {EDGES} select a, b from e order by md5('42' || ':' || a || ':' || b), a, b limit 300")
def al_random(spark: SparkSession, d: str) -> DataFrame:
    return active.random_pairs(edges(spark, d).select("a", "b"), 300)


@query(f"""with {TRIANGLES}, g as (select a, b, score, a as t1, b as t2, c as t3, 0 as place, round(abs(pab - 0.5), 9) as u from t union all select b, c, score, a, b, c, 1, round(abs(pbc - 0.5), 9) from t union all select a, c, score, a, b, c, 2, round(abs(pac - 0.5), 9) from t),
one as (select *, row_number() over (partition by t1, t2, t3 order by u, place) as r from g),
x as (select a, b, max(score) as score from g group by 1, 2 order by score desc, a, b limit 300), y as (select a, b, max(score) as score from one where r = 1 group by 1, 2 order by score desc, a, b limit 300), z as (select a, b, c, score from t order by score desc, a, b, c limit 100)
select 'BINARY' as mode, a, b, null as c, score from x union all select 'BINARY_UNCERTAINTY', a, b, null, score from y union all select 'TRINARY', a, b, c, score from z""")
def al_axiom(spark: SparkSession, d: str) -> DataFrame:
    """The worst pairs by their triangles, each triangle's most uncertain pair, and whole triangles at a cost of three."""
    t = stash(scored(spark, d), "triangles")
    pairs = active.axiom_edges(t.select("a", "b", "c", "score"), 300), active.axiom_uncertain(t, 300)
    parts = [x.select(F.lit(mode).alias("mode"), "a", "b", F.lit(None).cast("long").alias("c"), "score") for mode, x in zip(("BINARY", "BINARY_UNCERTAINTY"), pairs, strict=True)]
    whole = active.axiom_triangles(t, 300).select(F.lit("TRINARY").alias("mode"), "a", "b", "c", "score")
    return parts[0].unionByName(parts[1]).unionByName(whole)


@query(f"""with {POSTERIORS}, w as (select *, row_number() over (partition by truth order by md5('42' || ':' || a || ':' || b), a, b) as k from q where (truth and inf_unknown >= 0.1 and inf_unknown < 0.5) or (not truth and inf_unknown >= 0.2 and inf_unknown < 0.9))
select a, b, truth from w where k <= 100""")
def al_by_distance(spark: SparkSession, d: str) -> DataFrame:
    p = posteriors(spark, d).select("a", "b", "truth", F.col("inf_unknown").alias("dist"))
    return active.by_distance(p, [(True, 0.1, 0.5, 100), (False, 0.2, 0.9, 100)]).select("a", "b", "truth")


@query(f"with {EDGES} select a, b from e where p >= 0.5 and not truth")
def al_by_outcome(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("p >= 0.5 and not truth").select("a", "b")


@query(f"with {POSTERIORS} select a, b, row_number() over (partition by a order by inf_not desc, b) as place from q")
def al_by_order(spark: SparkSession, d: str) -> DataFrame:
    return posteriors(spark, d).select("a", "b", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("inf_not"), "b")).alias("place"))


@query(f"with {EDGES}, k as (select a, b, n, row_number() over (order by p desc, a, b) as place from e), t as (select *, row_number() over (partition by n order by place) as k from k) select a, b, n from t where k <= 200 order by place limit 300")
def al_budget(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.records import dense_index

    queue = dense_index(edges(spark, d).orderBy(F.desc("p"), "a", "b").select("a", "b", F.col("n").alias("task")), "place")
    return active.within_budget(queue, 300, 200, "place").select("a", "b", F.col("task").alias("n"))


@query()
def al_add_truth(spark: SparkSession, d: str) -> DataFrame:
    return active.seed_truth(records(spark, d).select("id", F.col("cluster_id").alias("cluster")), 500, 20)


# Human review

FLIP = unit_sql("42", "a", "b")


@query(f"with {EDGES} select a, b, case when {FLIP} >= 0.9 then not truth else truth end as answer from e")
def hu_simulate(spark: SparkSession, d: str) -> DataFrame:
    return active.simulated(edges(spark, d), 0.9).select("a", "b", "answer")


@query(f"with {EDGES}, h as (select p >= 0.5 as model, truth, case when {FLIP} >= 0.9 then not truth else truth end as human from e) select count(*) as pairs, count(*) filter (model = truth) as model_correct, count(*) filter (human = truth) as human_correct, count(*) filter (model <> truth and human = truth) as corrected from h")
def hu_report(spark: SparkSession, d: str) -> DataFrame:
    h = active.simulated(edges(spark, d), 0.9)
    return active.review_report(h.select((F.col("p") >= 0.5).alias("model"), F.col("answer").alias("human"), "truth"))


@query()
def hu_loop(spark: SparkSession, d: str) -> DataFrame:
    """Up to ten rounds of review with answers that are right in 95 of 100 cases; workflow.review_grid runs all accuracies and strategies."""
    from .workflow import review_loop

    return review_loop(edges(spark, d).select("a", "b", "p", "truth"), records(spark, d).select("id", "cluster_id"), accuracy=0.95, strategy="hybrid", tau=0.95, batch=300)


# Evaluation

SUMS = f"""with {RECORDS}, c as (select label, cluster_id, count(*) as n from r group by 1, 2),
s as (select (select sum(n * (n - 1) // 2) from c)::bigint as tp, (select sum(n * (n - 1) // 2) from (select sum(n)::bigint as n from c group by label))::bigint as l, (select sum(n * (n - 1) // 2) from (select sum(n)::bigint as n from c group by cluster_id))::bigint as k, (select count(*) from r) as total)"""
PAIRS = f"""{SUMS}, q as (select tp, l - tp as fp, k - tp as fn, total * (total - 1) // 2 - l - k + tp as tn, round(tp / l, 6) as precision, round(tp / k, 6) as recall from s)
select tp, fp, fn, tn, precision, recall, round(2 * precision * recall / (precision + recall), 6) as f1 from q"""


@query(PAIRS)
def ev_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pair_metrics(records(spark, d))


@query(f"""{SUMS}, l as (select label, max(n) as top, sum(n)::bigint as size from c group by 1), k as (select cluster_id, max(n) as top, sum(n)::bigint as size from c group by 1),
x as (select count(*) as exact from c join l using (label) join k using (cluster_id) where c.n = l.size and c.n = k.size)
select round((select sum(top) / sum(size) from l), 6) as group_precision, (select count(*) from l) as labels, round((select sum(top) / sum(size) from k), 6) as group_recall, (select count(*) from k) as clusters, exact, round(exact / (select count(*) from k), 6) as complete from x""")
def ev_groups_b(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.group_overlap(records(spark, d))


@query(f"""{SUMS}, l as (select label, sum(n)::bigint as r from c group by 1), k as (select cluster_id, sum(n)::bigint as i from c group by 1), j as (select n, r, i from c join l using (label) join k using (cluster_id))
select sum(n)::bigint as records, sum(n * n)::bigint as match, sum(n * (r + i - 2 * n))::bigint as mismatch, coalesce(sum(n) filter (r = n and i = n), 0)::bigint as complete, round(sum(n * n) / sum(n * r), 6) as precision, round(sum(n * n) / sum(n * i), 6) as recall, round(coalesce(sum(n) filter (r = n and i = n), 0) / sum(n), 6) as complete_share from j""")
def ev_groups_a(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.record_metrics(records(spark, d))


@query(f"""{POTENTIAL}, q as (select (select count(*) filter (p >= 0.5 and truth) / count(*) filter (p >= 0.5) from e) as precision, (select count(*) filter (x.component = y.component) / count(*) from e left join n x on a = x.node left join n y on b = y.node where truth) as recall)
select round(precision, 6) as precision, round(recall, 6) as potential_recall, round(2 * round(precision, 6) * round(recall, 6) / (round(precision, 6) + round(recall, 6)), 6) as f1 from q""")
def ev_current(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    truth = e.where("truth").select("a", "b")
    p = evaluate.with_scores(evaluate.confusion(e.withColumn("predicted", F.col("p") >= 0.5))).select("precision")
    r = graph.recall(graph.potential_pairs(e.where("p >= 0.5"), truth), truth).select(F.col("recall").alias("potential_recall"))
    return p.join(r).withColumn("f1", evaluate.f1(F.col("precision"), F.col("potential_recall")))


WORKER = f"{VOTES}, h as (select *, (a + b) % 2 = 0 as truth from v)"


@query(f"with {WORKER} select 'answer' as level, count(*) filter (answer = 1 and truth) as tp, count(*) filter (answer = 1 and not truth) as fp, count(*) filter (answer = 0 and truth) as fn, count(*) filter (answer = 0 and not truth) as tn from h union all select 'pair', count(*) filter (m >= 0.5 and truth), count(*) filter (m >= 0.5 and not truth), count(*) filter (m < 0.5 and truth), count(*) filter (m < 0.5 and not truth) from (select a, b, truth, avg(answer) as m from h group by all)")
def ev_worker(spark: SparkSession, d: str) -> DataFrame:
    h = votes(spark, d).withColumn("truth", (F.col("a") + F.col("b")) % 2 == 0)
    answers = evaluate.confusion(h.withColumn("predicted", F.col("answer") == 1)).select(F.lit("answer").alias("level"), "tp", "fp", "fn", "tn")
    pairs = h.groupBy("a", "b", "truth").agg((F.avg("answer") >= 0.5).alias("predicted"))
    return answers.unionByName(evaluate.confusion(pairs).select(F.lit("pair").alias("level"), "tp", "fp", "fn", "tn"))


@query(f"with {POSTERIORS}, c as (select truth, n, {CLASS} as decision from q) select decision, count(*) as pairs, count(*) filter (truth) as matches, count(*) filter (n > 1) as human, count(*) filter (n = 1) as machine from c group by 1")
def ev_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by decision, how many are matches, and how many people (answered, n > 1) and the machine decided."""
    human = F.count_if(F.col("n") > 1).alias("human"), F.count_if(F.col("n") == 1).alias("machine")
    return classified(spark, d).groupBy("decision").agg(F.count("*").alias("pairs"), F.count_if("truth").alias("matches"), *human)


@query(f"with {POSTERIORS}, c as (select truth, {CLASS} as decision from q) select scope, count(*) filter (decision = 'SAME') as same, count(*) filter (decision = 'NOT_SAME') as no, count(*) filter (decision = 'UNKNOWN') as unknown from (select 'matched' as scope, decision from c where truth union all select 'all', decision from c) group by 1")
def ev_sun_table(spark: SparkSession, d: str) -> DataFrame:
    """Decisions crossed with whether pairs match: of matched pairs, and of all."""
    c = classified(spark, d).withColumn("scope", F.explode(F.when(F.col("truth"), F.array(F.lit("matched"), F.lit("all"))).otherwise(F.array(F.lit("all")))))
    is_ = lambda x, name: F.count_if(F.col("decision") == x).alias(name)
    return c.groupBy("scope").agg(is_("SAME", "same"), is_("NOT_SAME", "no"), is_("UNKNOWN", "unknown"))


@query("""with c as (select count(*) filter (quality = 1 and toxic = 0) as tp, count(*) filter (quality = 1 and toxic = 1) as fp, count(*) filter (quality = 0 and toxic = 0) as fn, count(*) filter (quality = 0 and toxic = 1) as tn from labels),
s as (select *, case when tp + fp = 0 then 0 else round(tp / (tp + fp), 6) end as precision, case when tp + fn = 0 then 0 else round(tp / (tp + fn), 6) end as recall from c) select tp, fp, fn, tn, precision::double as precision, recall::double as recall, (case when precision + recall = 0 then 0 else round(2 * precision * recall / (precision + recall), 6) end)::double as f1 from s""")
def ev_binary(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels").select((F.col("quality") == 1).alias("predicted"), (F.col("toxic") == 0).alias("truth"))
    return evaluate.with_scores(evaluate.confusion(l))


@query(f"with {EDGES} select round(avg(case when (p * 10 <= 5) = (case when truth then 1 - p else (1 - p) * 9 + 1 end <= 5) then 1.0 else 0.0 end), 6) as accuracy, count(*) as pairs from e")
def ev_metric_model(spark: SparkSession, d: str) -> DataFrame:
    label = I.soft_label(F.col("truth"), F.col("p"))
    return edges(spark, d).agg(F.round(F.avg(((F.col("p") * 10 <= 5) == (label <= 5)).cast("double")), 6).alias("accuracy"), F.count("*").alias("pairs"))


INFORMATION = f"""{SUMS}, t as (select sum(n)::double as z from c), l as (select label, sum(n)::double as ln from c group by 1), k as (select cluster_id, sum(n)::double as cn from c group by 1),
i as (select sum(n / z * ln(n * z / (ln * cn))) as mi from c join l using (label) join k using (cluster_id), t), hl as (select -sum(ln / z * ln(ln / z)) as hl from l, t), hc as (select -sum(cn / z * ln(cn / z)) as hc from k, t),
q as (select mi / hc as h, mi / hl as g, (tp - l * k / (total * (total - 1) / 2)) / ((l + k) / 2 - l * k / (total * (total - 1) / 2)) as ari from s, i, hl, hc)
select round(ari, 6) as ari, round(2 * h * g / (h + g), 6) as nmi, round(h, 6) as homogeneity, round(g, 6) as completeness, round(2 * h * g / (h + g), 6) as v from q""".replace("ln(n * z / (ln * cn))", "ln(n * z / (l.ln * k.cn))").replace("sum(ln / z * ln(ln / z))", "sum(l.ln / z * ln(l.ln / z))").replace("sum(cn / z * ln(cn / z))", "sum(k.cn / z * ln(k.cn / z))").replace("from s, i, hl, hc", "from s, i, hl, hc")


@query(INFORMATION)
def ev_cluster_info(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.information(records(spark, d))


@query(f"""with {EDGES}, {RECORDS}, k as (select p >= 0.7 as model, truth, jaro_winkler_similarity(x.title, y.title) > 0.8 and jaro_winkler_similarity(x.author, y.author) > 0.7 as told from e join r x on a = x.id join r y on b = y.id)
select case when model = truth then 'none' when model then 'FP' else 'FN' end as by_truth, case when model = told then 'none' when model then 'FP' else 'FN' end as by_reference, count(*) as n from k group by 1, 2""")
def ev_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the model (from 0.7) by the truth, and by a reference: titles over 0.8 and authors over 0.7 alike."""
    at = lambda x: records(spark, d).select(F.col("id").alias(x), F.col("title").alias(f"t{x}"), F.col("author").alias(f"u{x}"))
    both = edges(spark, d).join(at("a"), "a").join(at("b"), "b")
    for x, y, name in (("ta", "tb", "title"), ("ua", "ub", "author")):
        both = both.join(both.select(x, y).distinct().withColumn(name, S.jaro_winkler(x, y)), [x, y])
    model, told = F.col("p") >= 0.7, (F.col("title") > 0.8) & (F.col("author") > 0.7)
    error = lambda right: F.when(model == right, "none").when(model, "FP").otherwise("FN")
    return both.groupBy(error(F.col("truth")).alias("by_truth"), error(told).alias("by_reference")).agg(F.count("*").alias("n"))


CURVE = " union all ".join(f"select '{name}' as strategy, p, truth, row_number() over (order by {order}, a, b) - 1 as place from e" for name, order in (("uncertainty", "round(abs(p - 0.5), 9)"), ("random", "md5('42' || ':' || a || ':' || b)")))


@query(f"""with {EDGES}, o as ({CURVE}), t as (select unnest(range(11)) * 1000 as tasks),
c as (select strategy, tasks, count(*) filter (truth and (place < tasks or p >= 0.5)) as tp, count(*) filter (not truth and place >= tasks and p >= 0.5) as fp, count(*) filter (truth and place >= tasks and p < 0.5) as fn from o, t group by 1, 2)
select strategy, tasks, round(2 * round(tp / (tp + fp), 6) * round(tp / (tp + fn), 6) / (round(tp / (tp + fp), 6) + round(tp / (tp + fn), 6)), 6) as f1 from c""")
def ev_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    """F1 after 0, 1000, ... 10000 review tasks, by the order in which pairs are asked about."""
    e = stash(edges(spark, d), "edges")
    orders = {"uncertainty": F.round(F.abs(F.col("p") - 0.5), 9), "random": F.md5(F.concat_ws(":", F.lit("42"), "a", "b"))}
    out = None
    for name, order in orders.items():
        step = dense_index(e.orderBy(order, "a", "b"), "place").withColumn("tasks", F.explode(F.sequence(F.lit(0), F.lit(10_000), F.lit(1_000))))
        told = F.col("place") < F.col("tasks")
        counted = step.withColumn("predicted", F.when(told, F.col("truth")).otherwise(F.col("p") >= 0.5))
        part = evaluate.with_scores(evaluate.confusion(counted, keys=["tasks"])).select(F.lit(name).alias("strategy"), F.col("tasks").cast("long").alias("tasks"), "f1")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""with recursive {EDGES}, s as (select a, b, truth, (a + b) % 3 = 0 as said from e where n > 1), g as (select a, b from s where said), {components_sql('g')},
c as (select count(*) filter (said and truth) as tp, count(*) filter (said and not truth) as fp, count(*) filter (not said and truth) as fn, count(*) filter (not said and not truth) as tn from s),
k as (select p_brand as c, coalesce(component, p_partkey) as l, count(*) as n from part left join n on p_partkey = node group by 1, 2), z as (select count(*) as clusters, sum(top) as top, sum(size) as size from (select l, max(n) as top, sum(n) as size from k group by 1))
select tp, fp, fn, tn, clusters, round(top / size, 6) as purity from c, z""")
def ev_llm_model(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in scorer over a list of pairs: its confusion, then the clusters that its matches make and their purity."""
    listed = edges(spark, d).where("n > 1").select("a", "b", "truth")
    stub = lambda part: [1.0 if (a + b) % 3 == 0 else 0.25 for a, b in zip(part["a"], part["b"], strict=True)]
    said = stash(listed.mapInPandas(P.scorer(stub), "a long, b long, truth boolean, score double").withColumn("predicted", F.col("score") >= 0.5), "said")
    label = graph.labels(records(spark, d).select("id"), said.where("predicted"))
    clusters = evaluate.group_overlap(records(spark, d).drop("label").join(label, "id")).select(F.col("labels").alias("clusters"), F.col("group_precision").alias("purity"))
    # One row each.
    return evaluate.confusion(said).join(clusters).select("tp", "fp", "fn", "tn", "clusters", "purity")


@query(f"with {POSTERIORS} select case when p >= 0.85 then 'exist' when p >= 0.5 then 'potential' else 'none' end as kind, cast(floor(inf_unknown * 10) as int) as bin, count(*) as n from q where truth group by 1, 2")
def ev_dist_plot(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p") >= 0.85, "exist").when(F.col("p") >= 0.5, "potential").otherwise("none")
    return posteriors(spark, d).where("truth").groupBy(kind.alias("kind"), F.floor(F.col("inf_unknown") * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))
