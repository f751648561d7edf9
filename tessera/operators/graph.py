"""Match graphs as edge lists (a < b): triangles, wedges, components, contraction, neighbour graphs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stash
from .pairs import _matrix, canonical, ranked, vector_pairs


def both_ways(edges: DataFrame) -> DataFrame:
    """u, v in both directions."""
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest reachable node): one row for each node with an edge to another node.

    Alternating large and small stars: each step joins with minima that were aggregated before the
    shuffle, nothing of a neighbourhood is collected, and the lineage ends with every round.
    """
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = stash(small, "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now


def labels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label for every vertex (id): its component, or itself."""
    return vertices.select("id").join(components(edges).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("label"))


def contracted(edges: DataFrame, label: DataFrame) -> DataFrame:
    """edges between labels (id, label): endpoints relabelled, loops dropped, parallel edges one."""
    at = lambda x: label.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label"))
    moved = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return canonical(moved.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c with a < b < c. Wedges are centred on the endpoint of smaller degree, so hubs don't explode."""
    degree = both_ways(edges).groupBy("u").agg(F.count("*").alias("n"))
    at = lambda x: degree.select(F.col("u").alias(x), F.struct("n", "u").alias(f"r{x}"))
    oriented = edges.select("a", "b").join(at("a"), "a").join(at("b"), "b").select(F.when(F.col("ra") < F.col("rb"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
    wedges = oriented.select("u", F.col("v").alias("x")).join(oriented.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = wedges.join(edges.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"])
    three = closed.select(F.array_sort(F.array("u", "x", "y")).alias("t"))
    return three.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def open_wedges(edges: DataFrame) -> DataFrame:
    """a, hub, c (a < c) where a-hub and hub-c are edges and a-c is none."""
    both = both_ways(edges)
    wedges = both.select(F.col("v").alias("hub"), F.col("u").alias("a")).join(both.select(F.col("u").alias("hub"), F.col("v").alias("c")), "hub").where("a < c")
    return wedges.join(edges.select("a", F.col("b").alias("c")), ["a", "c"], "left_anti").select("a", "hub", "c")


def common_neighbours(edges: DataFrame) -> DataFrame:
    """a, b, n: how many vertices are neighbours of both ends of each edge."""
    t = triangles(edges)
    sides = t.select(F.explode(F.array(F.struct("a", "b"), F.struct("a", F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("e")).select("e.a", "e.b")
    return edges.select("a", "b").join(sides.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def best_edge(edges: DataFrame) -> DataFrame:
    """The edge with most common neighbours, ends included; of equals the smallest ids."""
    return common_neighbours(edges).select("a", "b", (F.col("n") + 2).alias("score")).orderBy(F.desc("score"), "a", "b").limit(1)


def recall(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """found, total, recall of truth pairs among edges; 1 where there is none."""
    hit = truth.join(edges.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    return hit.agg(F.count("hit").alias("found"), F.count("*").alias("total")).withColumn("recall", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("found") / F.col("total"), 6)))


def potential_pairs(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth pairs that edges between matches connect, directly or not."""
    label = components(edges.join(truth, ["a", "b"], "left_semi"))
    at = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"{x}_at"))
    return truth.join(at("a"), "a").join(at("b"), "b").where("a_at = b_at").select("a", "b")


def adaptive_neighbours(found: DataFrame, n: int, near: float) -> DataFrame:
    """Edges of the distance graph: of each source as many nearest as lie within `near`, at least ln n and at most twice that."""
    k = int(math.log(n)) if n > 1 else 0
    inside = F.sum((F.col("dist") <= near).cast("int")).over(Window.partitionBy("src"))
    degree = F.least(F.greatest(inside, F.lit(k)), F.lit(2 * k))
    return ranked(found).withColumn("degree", degree).where("rank <= degree").select("src", "nbr", "dist", "rank")


def diverse_neighbours(vectors: DataFrame, near: float = 1.0, block: int = 1024) -> DataFrame:
    """Of each source's neighbours by distance, those that no accepted one is near to; at most log2 n.

    vectors: id, vector. All others are candidates. The order of acceptance matters, so it is a grouped
    function over a block of sources and all vectors; quadratic, as exact nearest neighbours are.
    """
    n = vectors.count()
    most = max(1, int(math.log2(n))) if n > 1 else 1
    blocks = max(1, math.ceil(n / block))
    other = vectors.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("own"))
    rows = other.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def accept(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _matrix(table.column("vector"))
        own = table.column("own").to_numpy() == table.column("block").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x, own = ids[order], x[order], own[order]
        norm = (x * x).sum(1)

        def away(i: int) -> np.ndarray:
            # Rounded, so that copies tie.
            return np.round(np.sqrt(np.maximum(norm + norm[i] - 2 * (x @ x[i]), 0)), 7)

        out = ([], [], [])
        for i in np.flatnonzero(own).tolist():
            dist = away(i)
            left = np.where(ids == ids[i], np.inf, dist)
            for _ in range(most):
                j = int(left.argmin())  # of equals the smallest id
                if not np.isfinite(left[j]):
                    break
                for o, v in zip(out, (ids[i], ids[j], np.sqrt(((x[i] - x[j]) ** 2).sum())), strict=True):
                    o.append(v)
                left[away(j) <= near] = np.inf
                left[j] = np.inf
        return pa.table({"src": pa.array(out[0], pa.int64()), "nbr": pa.array(out[1], pa.int64()), "dist": pa.array(out[2], pa.float64())})

    return rows.groupBy("block").applyInArrow(accept, "src long, nbr long, dist double")


def near_groups(vectors: DataFrame, near: float) -> tuple[DataFrame, DataFrame]:
    """(id, vector) of distinct vectors under their smallest id, and (id, label) of all: groups connected by distances up to `near`."""
    node = stash(vectors.groupBy("vector").agg(F.min("id").alias("id")), "nodes")
    at = labels(node, canonical(vector_pairs(node, "l2", within=near), "src", "nbr")).withColumnRenamed("id", "rep")
    rep = vectors.select("id", "vector").join(node.select(F.col("id").alias("rep"), "vector"), "vector").select("id", "rep")
    return node, stash(rep.join(at, "rep").select("id", "label"), "labels")


def blocks_of(vectors: DataFrame) -> int:
    """So many blocks that a product of two stays small."""
    return max(8, math.ceil(vectors.count() / 4096))


def compressed_neighbours(vectors: DataFrame, near: float = 1.0, m: int = 1) -> DataFrame:
    """Near vertices are united; representatives link to their m * log2 n nearest representatives."""
    node, label = near_groups(vectors, near)
    reps = stash(node.join(label.where("id = label").select("id"), "id").select("id", "vector"), "reps")
    n = reps.count()
    most = m * (int(math.log2(n)) if n > 1 else 1)
    return canonical(vector_pairs(reps, "l2", most=most), "src", "nbr")


def synergy_edges(vectors: DataFrame, near: float = 1.0) -> DataFrame:
    """Between groups of near vertices one edge each, the shortest over `near`; a group spends its size times log2 n.

    All vectors meet in pairs of blocks. What is among the shortest of a group is among its shortest in the
    part where it lies too, so each part gives no more than the group can spend.
    """
    node, label = near_groups(vectors, near)
    n = max(2, label.count())
    size = label.groupBy("label").agg(F.floor(F.count("*") * F.log2(F.lit(float(n)))).alias("most"))
    blocks = blocks_of(node)
    # Copies have the distances of their smallest id.
    dealt = stash(node.join(label, "id").join(size, "label").select("id", "label", "most", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")), "dealt")
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = each.select(F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "id", "label", "most", "vector")
    right = each.select(F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "id", "label", "most", "vector")

    def shortest(table: pa.Table) -> pa.Table:
        side, ids, at, most = (table.column(c).to_numpy() for c in ("side", "id", "label", "most"))
        x = _matrix(table.column("vector"))
        order = np.lexsort((ids, at))
        side, ids, at, most, x = side[order], ids[order], at[order], most[order], x[order]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = ([], [], [], [], [])
        if len(a) and len(b):
            norm, cols = (x * x).sum(1), np.flatnonzero(np.r_[True, at[b][1:] != at[b][:-1]])
            ends = np.r_[cols[1:], len(b)]
            for k in range(0, len(a), 512):
                r = a[k : k + 512]
                dist = np.sqrt(np.maximum(norm[r, None] + norm[b] - 2 * x[r] @ x[b].T, 0))
                dist[(dist <= near) | (at[r, None] >= at[None, b])] = np.inf
                low = np.minimum.reduceat(dist, cols, axis=1)
                rows = np.flatnonzero(np.r_[True, at[r][1:] != at[r][:-1]])
                low = np.minimum.reduceat(low, rows, axis=0)
                for u, (s, e) in enumerate(zip(rows, np.r_[rows[1:], len(r)], strict=True)):
                    d, m = low[u], int(most[r[s]])
                    # Ties at the border stay in.
                    v = np.flatnonzero(np.isfinite(d) & (d <= (np.partition(d, m - 1)[m - 1] if m < len(d) else np.inf)))
                    p, q = np.full(len(v), s), cols[v].copy()
                    for w in np.flatnonzero((ends[v] - cols[v]) * (e - s) > 1):
                        part = dist[s:e, cols[v[w]] : ends[v[w]]]
                        y = divmod(int(part.argmin()), part.shape[1])
                        p[w], q[w] = s + y[0], cols[v[w]] + y[1]
                    for o, z in zip(out, (at[r[p]], at[b[q]], d[v], ids[r[p]], ids[b[q]]), strict=True):
                        o.append(z)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table({c: pa.array(np.concatenate(o) if o else [], t) for c, o, t in zip(("src_label", "nbr_label", "dist", "src", "nbr"), out, kinds, strict=True)})

    found = left.unionByName(right).groupBy("i", "j").applyInArrow(shortest, "src_label long, nbr_label long, dist double, src long, nbr long")
    w = Window.partitionBy("src_label", "nbr_label").orderBy("dist", "src", "nbr")
    one = found.withColumn("k", F.row_number().over(w)).where("k = 1")
    spent = one.withColumn("r", F.row_number().over(Window.partitionBy("src_label").orderBy("dist", "src", "nbr"))).join(size.withColumnRenamed("label", "src_label"), "src_label")
    return spent.where("r <= most").select(F.least("src", "nbr").alias("a"), F.greatest("src", "nbr").alias("b"), "dist")


def contract_rounds(edges: DataFrame, same: DataFrame, most: int | None = None) -> DataFrame:
    """node, label after contracting edges by common neighbours until none is left.

    edges: a, b; same: a, b of pairs that are decided to be matches. Each round takes all edges
    that are best (most common neighbours, ties by a hash of the pair, so that rounds are wide) for
    both of their ends, contracts those that are matches of their members, and removes the others.
    An edge is decided in each round, so it ends; `most` stops it earlier. Where the order of the
    rounds isn't wanted, contract_all gives the same labels at once.
    """
    left, label = stash(edges.select("a", "b"), "left"), None
    rounds = 0
    while (most is None or rounds < most) and not left.isEmpty():
        rounds += 1
        scored = stash(common_neighbours(left), "scored")
        best = scored.select(F.col("a").alias("u"), F.col("b").alias("v"), "n").unionByName(scored.select(F.col("b").alias("u"), F.col("a").alias("v"), "n"))
        top = best.groupBy("u").agg(F.max_by("v", F.struct("n", F.xxhash64(F.least("u", "v"), F.greatest("u", "v")))).alias("v"))
        picked = top.join(top.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"]).where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))
        picked = stash(picked, "picked")
        now = same if label is None else contracted(same, label)
        merge = stash(picked.join(now.select("a", "b").distinct(), ["a", "b"], "left_semi"), "merge")
        rest = left.join(picked, ["a", "b"], "left_anti")
        if not merge.isEmpty():
            step = merge.select(F.col("b").alias("id"), F.col("a").alias("label"))
            rest = contracted(rest, step)
            label = step if label is None else label.join(step.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label")).unionByName(step).dropDuplicates(["id"])
            label = stash(label, "label")
        left = stash(rest, "left")
    every = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return every.select(F.col("id").alias("node"), F.col("id").alias("label")) if label is None else every.join(label, "id", "left").select(F.col("id").alias("node"), F.coalesce("label", "id").alias("label"))


def contract_all(edges: DataFrame, same: DataFrame) -> DataFrame:
    """node, label after all edges are contracted or removed, in whatever order.

    An edge between two groups is contracted if any pair of their members is decided to be a match, and
    an edge stays until it is decided. So each pair of `same` that is an edge ends in one group, and
    nothing else is contracted: the groups are the components of these pairs.
    """
    every = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return labels(every, edges.select("a", "b").join(same.select("a", "b"), ["a", "b"], "left_semi")).withColumnRenamed("id", "node")


def contract_limited(edges: DataFrame, budget: int, sure: float = 0.5) -> DataFrame:
    """a, b, decision (same, not, asked) of edges (a, b, inf_same, inf_not, inf_unknown), surest first.

    Sure edges are decided by themselves, the `budget` least unknown others are asked, and what is left takes the larger probability.
    """
    auto = F.when(F.col("inf_same") > sure, "same").when(F.col("inf_not") > sure, "not")
    asked = edges.where(auto.isNull()).orderBy("inf_unknown", "a", "b").limit(budget).select("a", "b", F.lit("asked").alias("asked"))
    return edges.join(asked, ["a", "b"], "left").select("a", "b", F.coalesce(auto, "asked", F.when(F.col("inf_same") >= F.col("inf_not"), "same").otherwise("not")).alias("decision"))


def leader_clusters(pairs: DataFrame, vertices: DataFrame, tau: float) -> DataFrame:
    """id, leader: in order of ids, each free record absorbs all free records that it matches.

    pairs: a, b, emb, score. Only records of one component meet, and only there the order counts.
    """
    fit = pairs.where((F.col("emb") >= 0.8 * tau) & (F.col("score") >= tau)).select("a", "b")
    label = components(fit).withColumnRenamed("node", "a")

    def lead(frame: pd.DataFrame) -> pd.DataFrame:
        links: dict[int, list[int]] = {}
        for r in frame.itertuples():
            links.setdefault(r.a, []).append(r.b)
            links.setdefault(r.b, [])
        taken, out = set(), []
        for x in sorted(links):
            if x not in taken:
                for y in [x, *links[x]]:
                    if y not in taken:
                        taken.add(y)
                        out.append((y, x))
        return pd.DataFrame(out, columns=["id", "leader"])

    led = fit.join(label, "a").groupBy("component").applyInPandas(lead, "id long, leader long")
    return vertices.select("id").join(led, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def merge_matching(scores: DataFrame) -> DataFrame:
    """a, b, score of a greedy matching, best first, each cluster at most once: rounds of pairs that are best for both ends."""
    left, chosen = stash(scores.select("a", "b", "score"), "left"), None
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("u"), "a", "b", "score").unionByName(left.select(F.col("b").alias("u"), "a", "b", "score"))
        top = ends.groupBy("u").agg(F.max(F.struct("score", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).alias("t")).select("u", (-F.col("t.x")).alias("a"), (-F.col("t.y")).alias("b"), "t.score")
        won = stash(top.groupBy("a", "b", "score").agg(F.count("*").alias("n")).where("n = 2").drop("n"), "won")
        chosen = won if chosen is None else chosen.unionByName(won)
        used = won.select(F.explode(F.array("a", "b")).alias("u"))
        left = stash(left.join(used.withColumnRenamed("u", "a"), "a", "left_anti").join(used.withColumnRenamed("u", "b"), "b", "left_anti"), "left")
    return chosen if chosen is not None else scores.select("a", "b", "score")


def merge_chain(scores: DataFrame, tau: float) -> DataFrame:
    """id, label of clusters merged by pairs of at least tau, best first, a merged cluster living on under its smaller id."""
    return components(scores.where(F.col("score") >= tau)).select(F.col("node").alias("id"), F.col("component").alias("label"))
