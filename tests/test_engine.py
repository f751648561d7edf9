"""Operators on hand-made rows with known answers."""

import hashlib
import math
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import digest
from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.operators import active, consistency, copies, embedding, evaluate, graph, pairs
from tessera.operators import inference as I
from tessera.plans import io, pairing
from tessera.plans.workflow import Workflow
from tessera.sources import records as R
from tessera.sources import tasks as T
from tessera.sources.shared import written


def pairs_of(spark, rows, columns="a long, b long, p double"):
    return spark.createDataFrame(rows, columns)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_closed_triangle(spark):
    got = consistency.scored_triangles(pairs_of(spark, [(1, 2, 0.95), (2, 3, 0.2), (1, 3, 1.0)])).first()
    assert round(got["score"], 6) == 0.77


def test_missing_edge_in_both_directions(spark):
    got = consistency.missing_edges(pairs_of(spark, [(1, 2, 0.9), (2, 3, 0.9)]), 0.8).collect()
    assert {(r["a"], r["c"]) for r in got} == {(1, 3), (3, 1)}
    assert all(abs(r["transitive"] - 0.9) < 1e-9 and abs(r["confidence"] - 0.5) < 1e-9 for r in got)


@pytest.mark.parametrize(("kinds", "code"), [("SSN", 102), ("SSU", 12), ("SNU", 111), ("SUU", 21), ("NUU", 120), ("UUU", 30)])
def test_axiom_codes(spark, kinds, code):
    names = {"S": "SAME", "N": "NOT_SAME", "U": "UNKNOWN"}
    c = consistency.axiom_code(*(F.lit(names[k]) for k in kinds))
    assert tuple(one(spark, c.alias("c"), consistency.inconsistent(c).alias("i"))) == (code, True)


def test_cluster_metrics(spark):
    rows = spark.createDataFrame([(1, "x", "1"), (2, "x", "1"), (3, "x", "2"), (4, "y", "2")], "id long, label string, cluster_id string")
    m = evaluate.pair_metrics(rows).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (1, 2, 1, 2) and m["f1"] == 0.4
    g = evaluate.group_overlap(rows).first()
    assert (g["group_precision"], g["group_recall"], g["exact"]) == (0.75, 0.75, 0)
    same = rows.withColumn("label", F.col("cluster_id"))
    i = evaluate.information(same).first()
    assert (i["ari"], i["v"]) == (1.0, 1.0)


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "id long, label string, cluster_id string")
    assert evaluate.confusion(none.select(F.lit(True).alias("predicted"), F.lit(True).alias("truth"))).first()["tp"] == 0
    empty = spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")
    assert evaluate.with_scores(empty, 1.0).first()["precision"] == 1.0
    assert evaluate.with_scores(empty).first()["f1"] == 0.0


def test_year_similarity(spark):
    got = [one(spark, S.year_similarity(F.lit("2000"), F.lit(y)).alias("s"))["s"] for y in ("2000", "2001", "2002", "2005", "2010", "2011", None)]
    assert got == [1.0, 0.9, 0.8, 0.7, 0.5, 0.3, 0.5]


def test_strings(spark):
    jw = spark.createDataFrame([("MARTHA", "MARHTA"), ("abxxxxxx", "abyyyyyy"), ("", ""), (None, "a")], "a string, b string").select(S.jaro_winkler("a", "b").alias("s")).collect()
    assert [round(r["s"], 7) if r["s"] is not None else None for r in jw] == [0.9611111, 0.5, 1.0, None]
    assert one(spark, S.token_overlap(X.tokens(F.lit("a b c")), X.tokens(F.lit("b c d e"))).alias("s"))["s"] == 0.5
    assert one(spark, S.lev_norm(F.lit("竜"), F.lit("龍")).alias("s"))["s"] == 0.5
    assert one(spark, X.norm_title(F.lit("本の　題 [叢書 1]")).alias("s"))["s"] == "本の 題"
    assert one(spark, X.norm_author(F.lit("山田 龍之介/著 (訳)")).alias("s"))["s"] == "山田竜之介"
    assert one(spark, X.norm_spaces(F.lit("ＡＢ【１】")).alias("s"))["s"] == "AB 1"
    assert one(spark, X.parse_labelled_score(F.lit("about 7 points")).alias("s"))["s"] == 0.7


def test_flat_bayes(spark):
    ones = [F.lit(1.0)] * 4
    p, _ = I.bayes(ones, ones)
    assert abs(one(spark, p.alias("p"))["p"] - 0.1) < 1e-9


def test_votes(spark):
    answers = spark.createDataFrame([('{"2,1": true}',), ('{"1,2": true}',), ('{"1,2": false, "1,3": false}',)], "result string")
    got = {(r["a"], r["b"]): r["m"] for r in T.answers_of(answers).groupBy("a", "b").agg(F.avg("answer").alias("m")).collect()}
    assert got == {(1, 2): pytest.approx(2 / 3), (1, 3): 0.0}


def test_components_and_contraction(spark):
    e = pairs_of(spark, [(1, 2, 1.0), (2, 3, 1.0), (5, 6, 1.0)])
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    label = graph.labels(spark.range(7), e)
    assert {r["id"]: r["label"] for r in label.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    assert graph.contracted(pairs_of(spark, [(1, 5, 1.0), (3, 6, 1.0), (1, 2, 1.0)]), label).collect()[0][:] == (1, 5)
    merged = graph.contract_rounds(e, e.where("a < 5"))
    assert {r["node"]: r["label"] for r in merged.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 6}


def test_greedy_matching_is_the_sequential_one(spark):
    rows = [(1, 2, 0.9), (2, 3, 0.95), (3, 4, 0.8), (4, 5, 0.7), (5, 6, 0.7)]
    got = sorted((r["a"], r["b"]) for r in graph.merge_matching(pairs_of(spark, rows, "a long, b long, score double")).collect())
    assert got == [(2, 3), (4, 5)]


def test_leaders(spark):
    rows = [(1, 2, 0.9, 0.9), (2, 3, 0.9, 0.9), (3, 4, 0.9, 0.9)]
    got = {r["id"]: r["leader"] for r in graph.leader_clusters(spark.createDataFrame(rows, "a long, b long, emb double, score double"), spark.range(1, 6), 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_minhash_finds_copies_once(spark):
    sets = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(50)] + [(99, ["x"]), (100, [])], "id long, items array<string>")
    got = pairs.minhash_pairs(sets).collect()
    assert len(got) == 49 and {r["a"] for r in got} == {0}


def test_nearest_vectors_are_exact(spark):
    rows = [(i, [float(i % 7), float(i // 7)]) for i in range(49)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got: dict = {}
    for r in pairs.ranked(pairs.vector_pairs(v, "l2", blocks=3, most=4)).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["nbr"])
    for i, x in rows:
        order = sorted((j for j, _ in rows if j != i), key=lambda j: (sum((a - b) ** 2 for a, b in zip(x, rows[j][1], strict=True)), j))
        assert got[i] == order[:4]


def test_neighbour_graphs_with_a_group_of_copies(spark):
    """A group of 50 near copies, 10 of them exact, among groups of 2 and single vectors, against brute force."""
    rng = np.random.default_rng(5)
    hot = rng.normal(size=4)
    x = [hot + rng.normal(size=4) * (0.02 if i < 40 else 0) for i in range(50)]
    for i in range(30):
        v = rng.normal(size=4) * 4
        x += [v, v + 0.1] if i % 2 else [v]
    x = np.array(x)[rng.permutation(len(x))]
    n, near = len(x), 1.0
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    most = int(math.log2(n))
    label = list(range(n))
    for _ in range(n):
        label = [min(label[j] for j in range(n) if dist[i, j] <= near) for i in range(n)]

    diverse = set()
    for i in range(n):
        covered, got = set(), 0
        for j in sorted((j for j in range(n) if j != i), key=lambda j: (dist[i, j], j)):
            if j not in covered and got < most:
                diverse.add((i, j))
                got += 1
                covered |= {k for k in range(n) if dist[j, k] <= near}
    reps = sorted(set(label))
    compressed = {(min(i, j), max(i, j)) for i in reps for j in sorted((j for j in reps if j != i), key=lambda j: (dist[i, j], j))[: int(math.log2(len(reps)))]}
    synergy = set()
    for u in reps:
        own = [i for i in range(n) if label[i] == u]
        best = [min((dist[i, j], i, j) for i in own for j in range(n) if label[j] == v and dist[i, j] > near) for v in reps if v > u]
        synergy |= {(min(i, j), max(i, j)) for _, i, j in sorted(best)[: int(len(own) * math.log2(n))]}

    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    assert {(r["src"], r["nbr"]) for r in graph.diverse_neighbours(frame, near, 32).collect()} == diverse
    assert {(r["a"], r["b"]) for r in graph.compressed_neighbours(frame, near).collect()} == compressed
    assert {(r["a"], r["b"]) for r in graph.synergy_edges(frame, near).collect()} == synergy


def test_simulated_review(spark):
    rows = pairs_of(spark, [(i, i + 1, 0.5) for i in range(200)]).withColumn("truth", F.col("a") % 2 == 0)
    assert active.simulated(rows, 1.0).where("answer <> truth").count() == 0
    assert 0 < active.simulated(rows, 0.8).where("answer <> truth").count() < 80


def test_record_shapes():
    doc = {"version": "2.2", "type": "NORMAL", "books": {"c": [{"id": "1", "group": "c", "title": "t"}]}}
    assert list(R.flattened(R.upgraded(doc))) == [{"id": "1", "cluster_id": "c", "data": {"title": "t"}}]
    assert list(R.flattened({"group": [{"records": [{"title": "x"}]}]})) == [{"id": "record_0_0", "cluster_id": "0", "data": {"title": "x"}}]
    assert list(R.flattened({"records": {"k": {"title": None}}})) == [{"id": "record_0_0", "cluster_id": "k", "data": {"title": ""}}]
    with pytest.raises(ValueError, match="unknown version"):
        R.upgraded({"version": "9"})


def test_json_repair(spark):
    broken = spark.createDataFrame([("```json\n{'a': 1,}\n```",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in broken.select(X.repair_json("t")).collect()] == ['{"a": 1}', "{}", "{}"]


def test_workflow():
    seen = []
    w = Workflow({"NGRAPH_CONSTRUCTION": lambda s, t: seen.append(t["loop_count"]), "OUTPUT_RESULT": lambda s, t: s | {"done": True}})
    plan = [{"task": "LOOP", "times": 2, "tasks": [{"task": "NGRAPH_CONSTRUCTION"}]}, {"task": "OUTPUT_RESULT", "suspend": True}]
    assert w.run(plan) == ({"done": True}, 3) and seen == [0, 1]
    with pytest.raises(ValueError, match="unknown task"):
        w.run([{"task": "NO_SUCH"}])


def test_batches_of_a_scorer():
    sizes = []
    score = pairs.scorer(lambda part: sizes.append(len(part)) or [0.5] * len(part), 4)
    out = pd.concat(score([pd.DataFrame({"a": range(10), "b": range(10)})]))
    assert sizes == [4, 4, 2] and len(out) == 10


def test_contraction_in_rounds_and_at_once(spark):
    import random

    from tessera.operators import graph

    rng = random.Random(2)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(40)) if a < b})
    same = [p for p in pairs if rng.random() < 0.3]
    e, s = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(same, "a long, b long")
    groups = lambda df: sorted(sorted(m) for m in by_label(df).values())

    def by_label(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["label"], []).append(r["node"])
        return out

    assert groups(graph.contract_rounds(e, s)) == groups(graph.contract_all(e, s))


def test_vector_distances_do_not_depend_on_blocks(spark):
    import numpy as np

    from tessera.operators import pairs as P

    x = np.random.default_rng(3).standard_normal((60, 5)) * 1e-3 + 1000
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "id long, vector array<double>")
    want = {i: sorted(((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(60) if j != i))[:3] for i in range(60)}
    for blocks in (1, 5):
        got = {}
        for r in P.ranked(P.vector_pairs(v, "l2", blocks=blocks, most=3)).orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append((r["dist"], r["nbr"]))
        assert {i: [n for _, n in g] for i, g in got.items()} == {i: [n for _, n in w] for i, w in want.items()}
        assert all(abs(d - w) < 1e-12 for i in got for (d, _), (w, _) in zip(got[i], want[i], strict=True))


def test_records_are_numbered_in_file_order(spark, tmp_path):
    folder, k = tmp_path / "records.tsv", 0
    folder.mkdir()
    # Later files are larger: a reader takes the largest first.
    for part, n in enumerate((2, 50, 2000)):
        folder.joinpath(f"part-{part:05d}.tsv").write_text("title\n" + "".join(f"t{i}\n" for i in range(k, k + n)))
        k += n
    got = R.read_any(spark, f"file://{folder}", ["title"]).select("idx", R.field("title").alias("title")).collect()
    assert sorted((r["idx"], r["title"]) for r in got) == [(i, f"t{i}") for i in range(k)]


def test_top_pairs_go_by_the_rounded_score(spark, monkeypatch):
    rows = [(k, k + 1, 1.0) for k in range(10, 309)] + [(5, 6, 0.5000001), (3, 4, 0.5)]
    monkeypatch.setattr(pairing, "edges", lambda spark, d: pairs_of(spark, rows))
    assert [(r["a"], r["b"]) for r in pairing.so_topk(spark, "").collect()][-1] == (3, 4)
    assert [r["a"] for r in pairing.so_score_desc(spark, "").collect()][-2:] == [3, 5]


def test_information_of_large_clusters(spark):
    # A cluster of 80,000 has 3.2e9 pairs, whose square is over 2^63.
    rows = spark.range(80_001).select("id", *(F.when(F.col("id") < 80_000, "x").otherwise("y").alias(c) for c in ("label", "cluster_id")))
    i = evaluate.information(rows).first()
    assert (i["ari"], i["v"]) == (1.0, 1.0)


def test_order_sums_over_64_bits(spark):
    rows = [("P", 1, 1 << 40, 1 << 21, 0)] * 4 + [("P", 2, 1, 5, 7)]
    frame = spark.createDataFrame(rows, "platform string, file int, at long, a long, b long")
    assert {r["file"]: int(r["order_sum"]) for r in io.order_sums(frame).collect()} == {1: 1 << 63, 2: 26}
    assert io.order_sums(frame.where("file = 2")).schema["order_sum"].dataType.typeName() == "long"


def test_norms_are_computed_once_a_row(spark):
    # Ten times as wide takes ten times as long; with a norm for each element, a hundred times.
    def seconds(width):
        rows = spark.range(0, 200, 1, 1).select(X.onehot_digits((F.col("id") + 1_000_000).cast("string"), width).alias("v"))
        began = time.time()
        rows.agg(F.sum(F.size(F.filter("v", lambda x: x > 0)))).first()
        return time.time() - began

    seconds(30)
    assert seconds(3000) < 20
    got = one(spark, X.onehot_digits(F.lit("12"), 30).alias("v"), S.l2_normalised(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), S.l2_normalised(F.lit(None).cast("array<double>")).alias("n"))
    assert [round(x, 6) for x in got["v"]] == [0.707107 if i in (1, 12) else 0.0 for i in range(30)]
    assert got["z"] == [0.0, 0.0] and got["n"] is None


def test_vectors_by_cache(spark):
    vectors = embedding.hashed_vectors(spark.range(0, 20_000, 1, 1).select("id", F.concat(F.lit("ring "), "id").alias("t")), "t")
    began = time.time()
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    assert vectors.where(F.abs(norm - 1) < 1e-9).count() == 20_000 and time.time() - began < 20


def test_buckets_without_rows_for_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BUCKET_BLOCK", 8)
    rng = np.random.default_rng(3)
    x = rng.integers(-4, 4, (60, 5)) / 4
    rows = [(int(i % 55), [None if v == 0.75 else float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, [0.5])]
    got = pairs.bucket_pairs(spark.createDataFrame(rows, "id long, vector array<double>"), top=4, scale=2, shared=2)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    dims = [r["dim"] for r in pairs.variance_dimensions(spark.createDataFrame(rows, "id long, vector array<double>"), 4).collect()]
    cells = [(i, {d: math.floor(v[d] * 2) for d in dims if v and d < len(v) and v[d] is not None}) for i, v in rows]
    want = {}
    for i, u in cells:
        for j, v in cells:
            if i < j:
                want[i, j] = want.get((i, j), 0) + sum(u[d] == v[d] for d in u.keys() & v.keys())
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == {p: n for p, n in want.items() if n >= 2}


def test_pairs_of_one_cluster_are_dealt_to_many_tasks(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2990, "x").when(F.col("id") < 2999, "y").alias("c"))
    met = pairs.intra_cluster(rows, "id", "c")
    tasks = met.groupBy(F.spark_partition_id().alias("t"), "cluster").agg(F.count("*").alias("n"), F.count_if(F.col("a") >= F.col("b")).alias("bad")).collect()
    assert sum(r["n"] for r in tasks) == 2990 * 2989 // 2 + 9 * 8 // 2 and not any(r["bad"] for r in tasks)
    assert max(r["n"] for r in tasks) < 2990 * 2989 // 8
    assert met.distinct().count() == met.count()


def test_lowest_pairs_by_hash(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "x" if i < 60 else "y" if i < 65 else "z" if i < 66 else None) for i in range(70)], "id long, c string")
    md5 = lambda p: (hashlib.md5(f"42:{p[0]}:{p[1]}".encode()).hexdigest(), *p)
    want = {("x", *p) for p in sorted(((a, b) for b in range(60) for a in range(b)), key=md5)[:20]} | {("y", *p) for p in sorted(((a, b) for b in range(60, 65) for a in range(60, b)), key=md5)[:20]}
    found = pairs.lowest_pairs(rows, "id", "c", 20)
    # Neither a sort nor a shuffle of all pairs: what is ranked was bounded and written before.
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == want
    # A cluster whose rows are copies has fewer pairs than its size says, and is done again.
    copies = spark.createDataFrame([(i % 3, "x") for i in range(300)], "id long, c string")
    assert pairs.lowest_pairs(copies, "id", "c", 1000).count() == 1000


def test_near_copies_in_a_crowd_make_few_pairs(spark, monkeypatch):
    compared = []
    monkeypatch.setattr(copies, "stash", lambda df, what, f=copies.stash: (lambda out: compared.append(out.count()) or out if what == "pairs" else out)(f(df, what)))
    # 200 variants of one text, a chain whose ends are not alike, copies, and texts by themselves.
    crowd = [(i, [f"w{k}" for k in range(100)] + [f"v{i}"]) for i in range(200)]
    chain = [(300 + i, [f"c{k}" for k in range(i * 4, i * 4 + 40)]) for i in range(10)]
    rest = [(400, ["x", "y"]), (401, ["y", "x"]), (402, ["x"]), (403, []), (404, None)]
    sets = spark.createDataFrame(crowd + chain + rest, "id long, items array<string>")
    got = {r["id"]: r["label"] for r in copies.near_copies(sets, 0.8).collect()}
    assert got == {i: 0 for i in range(200)} | {300 + i: 300 for i in range(10)} | {400: 400, 401: 400, 402: 402, 403: 403, 404: 404}
    assert sum(compared) < 3000


def test_matched_pairs_are_dealt_to_many_tasks_and_written_small(spark):
    rows = spark.range(1500).select("id", F.lit("x").alias("label"), (F.col("id") % 2).cast("string").alias("cluster_id"), F.lit("a title").alias("title"))
    met = R.matched_pairs(rows, ["title"])
    assert met.columns == ["label", "id1", "title1", "id2", "title2", "correct"]
    tasks = met.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if("correct").alias("c"), F.count_if(F.col("id1") >= F.col("id2")).alias("bad")).collect()
    assert (sum(r["n"] for r in tasks), sum(r["c"] for r in tasks), sum(r["bad"] for r in tasks)) == (1500 * 1499 // 2, 2 * (750 * 749 // 2), 0)
    assert max(r["n"] for r in tasks) < 1500 * 1499 // 4
    back = written(met, "pairs", "csv", "gzip")
    assert back.count() == 1500 * 1499 // 2 and all(f.endswith(".gz") for f in back.inputFiles())


def test_pairs_of_a_cluster_come_in_runs_of_one_record(spark):
    rows = spark.range(1200).select("id", F.lit("x").alias("c"))
    a = np.array([r["a"] for r in pairs.intra_cluster(rows, "id", "c").select("a").collect()])
    assert len(a) == 1200 * 1199 // 2
    # Columnar files of the result stay small.
    assert (np.diff(a) != 0).sum() < len(a) / 50


def test_a_file_of_matched_pairs_takes_less_than_a_byte_a_pair(spark, tmp_path):
    part = spark.range(1500).select(F.col("id").alias("p_partkey"), F.concat(F.lit("a title "), F.col("id") % 40).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), F.lit(1).alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    back = io.snk_matched_pairs(spark, str(tmp_path))
    assert back.distinct().count() == back.count() == 1500 * 1499 // 2 and back.where("id1 >= id2 or not correct").isEmpty()
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in back.inputFiles()) < 1500 * 1499 // 2


def test_low_digests_of_pairs():
    rows = lambda xs: np.frombuffer(b"".join(xs), np.uint8).reshape(len(xs), -1)
    for before, after in ((b"42:%05d:", b"%05d"), (b"42:%03d:", b"%08d"), (b"%08d", b"x%046d"), (b"%048d", b"%07d"), (b"%052d", b"%03d")):
        p, s, start = [before % i for i in range(40)], [after % i for i in range(1000)], np.minimum(np.arange(40) * 20, 1000)
        x, y = digest.low_pairs(rows(p), start, rows(s), 1 << 28)
        want = {(i, j) for i in range(40) for j in range(start[i], 1000) if int(hashlib.md5(p[i] + s[j]).hexdigest()[:8], 16) <= 1 << 28}
        assert len(x) == len(want) > 100 and set(zip(x.tolist(), y.tolist(), strict=True)) == want


def test_lowest_pairs_of_other_keys_and_copies_in_rounds(spark, monkeypatch):
    low = []
    monkeypatch.setattr(pairs, "stash", lambda df, what, f=pairs.stash: (lambda out: low.append(out.count()) or out if what == "low" else out)(f(df, what)))
    monkeypatch.setattr(pairs, "LEAST_BLOCK", 16)
    names = ["é" * (i % 40) + str(i) for i in range(120)]
    md5 = lambda p: (hashlib.md5(f"42:{p[0]}:{p[1]}".encode()).hexdigest(), *p)
    want = sorted(((a, b) for a in names for b in names if a < b), key=md5)[:30]
    assert {tuple(r) for r in pairs.lowest_pairs(spark.createDataFrame([(n, 7) for n in names], "id string, c int"), "id", "c", 30).collect()} == {(7, *p) for p in want}
    # 60 keys with 20 copies each: few different pairs are low, but no round has all 708,000 pairs as rows.
    low.clear()
    copies = spark.createDataFrame([(i % 60, "x") for i in range(1200)], "id long, c string")
    want = sorted(((a, b) for b in range(60) for a in range(b)), key=md5)[:1]
    assert {tuple(r) for r in pairs.lowest_pairs(copies, "id", "c", 100).collect()} == {("x", *p) for p in want}
    assert max(low) < 100000


def test_training_pairs_hash_no_rows_of_pairs(spark, monkeypatch, tmp_path):
    plans = []
    monkeypatch.setattr(pairs, "stash", lambda df, what, f=pairs.stash: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if what == "low" else None, f(df, what))[1])
    part = spark.range(200).select(F.col("id").alias("p_partkey"), F.lit("a title").alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 2).alias("p_brand"), F.lit("LARGE").alias("p_type"), F.lit(1).alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    found = pairing.in_train_pairs(spark, str(tmp_path)).collect()
    md5 = lambda p: (hashlib.md5(f"42:{p[0]}:{p[1]}".encode()).hexdigest(), *p)
    want = {p for c in (0, 1) for p in sorted(((a, b) for b in range(c, 200, 2) for a in range(c, b, 2)), key=md5)[:50]}
    assert {(r["a"], r["b"]) for r in found if r["match"]} == want and sum(not r["match"] for r in found) == 100
    assert plans and not any("md5" in p for p in plans)
