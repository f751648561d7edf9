"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node, with their ids in order, so groups of copies are searched once
and expanded at the end. The graph is built from random neighbours by rounds of a Spark
join: each node meets the nodes that its neighbours and its reverse neighbours know
(neighbours of neighbours), with their vectors, and keeps the nearest. Reverse neighbours
are a sample by hash where a node has very many, as in the published method.

Queries start at their own nodes. A round opens the nearest unopened nodes of each query's
pool, joins them with the graph, and puts their neighbours' distances into the pool; it
ends when no query has an unopened node among its `ef` nearest, or after `rounds`.

Distances are Euclidean in double precision, over original components. Vectors that are
null, zero, or hold null or non-finite components take no part, neither do those whose
length is not that of most; a null id is dropped. Repeated rows count as further rows of
that id. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

#: Neighbours of a node in the graph, and links of a node that a round of descent looks at.
DEGREE, SAMPLE = 24, 16


def usable(vectors: DataFrame) -> DataFrame:
    """id, vector (array of double) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = "id is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)"
    rows = rows.where(fine)
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (common[0]["n"] if common else 0))


def distinct_nodes(rows: DataFrame, keep: int) -> DataFrame:
    """node (the smallest id), vector, ids (the `keep` smallest ids): one row for each distinct vector.

    Ids beyond `keep` can't be among the keep - 1 nearest of any other row, as smaller ids come first.
    """
    own = first_of(rows.withColumn("h", F.xxhash64("vector")), ["h", "vector"], ["id"], keep)
    return own.groupBy("h", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("node"), "vector", "ids")


def first_of(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key; Spark limits each task's rows of a key before the shuffle, so hot keys stay small."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("at") <= most).drop("at")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def local_join(table: pa.Table) -> pa.Table:
    """Of the nodes that meet at a hub: for each the nearest DEGREE // 2 others.

    Rows: hub, node, vector; nodes of a hub are at most 2 * SAMPLE + 1.
    """
    hub, node, x = table.column("hub").to_numpy(), table.column("node").to_numpy(), matrix(table.column("vector")).astype(np.float32)
    order = np.lexsort((node, hub))
    hub, node, x = hub[order], node[order], x[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], hub[1:] != hub[:-1]])), len(hub))
    a, b, d = [], [], []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, ids = x[i:j], node[i:j]
        norms = (own * own).sum(1)
        dist = norms[:, None] + norms - 2 * (own @ own.T)
        dist[ids[:, None] == ids] = np.inf
        k = min(DEGREE // 2, j - i - 1)
        if k > 0:
            near = np.argpartition(dist, k - 1, axis=1)[:, :k]
            far = np.take_along_axis(dist, near, 1)
            fine = np.isfinite(far)
            a.append(np.repeat(ids, k).reshape(-1, k)[fine])
            b.append(ids[near][fine])
            d.append(np.maximum(far[fine], 0))
    cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0), t)
    return pa.table({"node": cat(a, pa.int64()), "nbr": cat(b, pa.int64()), "d": cat(d, pa.float32())})


def nearest(edges: DataFrame) -> DataFrame:
    """node, nbrs: the DEGREE nearest of its links as an array of (d, nbr), nearest first."""
    best = first_of(edges.groupBy("node", "nbr").agg(F.min("d").alias("d")), ["node"], ["d", "nbr"], DEGREE)
    return best.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "nbr"))).alias("nbrs"))


def build_graph(nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """node, nbrs: the neighbour graph of nodes (node, vector)."""
    spark = nodes.sparkSession
    vectors = nodes.select("node", F.col("vector").cast("array<float>").alias("vector"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Start: nodes meet at random, in hubs of 2 * SAMPLE by two hashes of their ids.
    n = nodes.count()
    hubs = max(1, n // (2 * SAMPLE))
    start = [vectors.withColumn("hub", F.pmod(F.xxhash64("node", F.lit(i)), F.lit(hubs))) for i in range(2)]
    joined = None
    for s in start:
        # A hub of a hash may be larger than meant by chance, not by data, as ids are distinct.
        part = s.groupBy(F.pmod("hub", F.lit(4 * parts)).alias("part")).applyInArrow(lambda t: local_join(t.select(["hub", "node", "vector"])), "node long, nbr long, d float")
        joined = part if joined is None else joined.unionByName(part)
    graph = stash(nearest(joined), "graph")
    for r in range(rounds):
        links = graph.select("node", F.explode("nbrs").alias("x")).select("node", "x.nbr", "x.d")
        # Forward links: half the nearest, half by hash of this round, so that rounds look at different ones.
        forward = graph.select("node", F.expr(f"slice(array_sort(transform(nbrs, x -> struct(xxhash64(x.nbr, node, {r}) as h, x.nbr as nbr))), 1, {SAMPLE})").alias("s")).select(F.col("node").alias("hub"), F.explode("s.nbr").alias("node"))
        back = links.select(F.col("nbr").alias("hub"), "node", F.xxhash64("node", "nbr", F.lit(r)).alias("h"))
        back = first_of(back, ["hub"], ["h", "node"], SAMPLE).select("hub", "node")
        meet = forward.unionByName(back).unionByName(graph.select(F.col("node").alias("hub"), "node")).distinct()
        with_vectors = meet.join(vectors, "node").withColumn("part", F.pmod(F.xxhash64("hub"), F.lit(4 * parts)))
        found = with_vectors.groupBy("part").applyInArrow(lambda t: local_join(t.select(["hub", "node", "vector"])), "node long, nbr long, d float")
        graph = stash(nearest(links.unionByName(found)), "graph")
    return graph


def adjacency(graph: DataFrame) -> DataFrame:
    """node, nbrs (array of ids): links in both directions; of reverse links the DEGREE shortest of a node."""
    links = graph.select("node", F.explode("nbrs").alias("x")).select("node", "x.nbr", "x.d")
    back = first_of(links.select(F.col("nbr").alias("node"), "d", F.col("node").alias("nbr")), ["node"], ["d", "nbr"], DEGREE).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "nbr"))).alias("s"))
    return graph.join(back, "node", "left").select("node", F.array_union(F.col("nbrs.nbr"), F.coalesce(F.col("s.nbr"), F.expr("cast(array() as array<bigint>)"))).alias("nbrs"))


def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, node, d from query, node, q (query's vector), vector."""
    for batch in batches:
        if batch.num_rows:
            gap = matrix(batch.column("q")) - matrix(batch.column("vector"))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(np.sqrt((gap * gap).sum(1)), pa.float64())], ["query", "node", "d"])


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, ef: int = 400, width: int = 100, rounds: int = 10) -> DataFrame:
    """query, node, d: the up to `ef` nearest nodes that greedy search finds.

    queries: query (id), node (where it starts), q (its vector). `width` nodes are opened a round.
    """
    links = stash(adjacency(graph), "links")
    vectors = nodes.select("node", "vector")
    pool = stash(queries.select("query", F.array(F.struct(F.lit(0.0).cast("double").alias("d"), "node", F.lit(False).alias("opened"))).alias("pool")), "pool")
    asked = queries.select("query", "q")
    for r in range(rounds):
        # Few nodes at first, so that the search comes near before it widens.
        most = min(width, 8 * 4**r)
        chosen = pool.withColumn("open", F.slice(F.expr("filter(pool, x -> not x.opened)"), 1, most)["node"])
        if chosen.where("size(open) > 0").isEmpty():
            break
        chosen = stash(chosen.select("query", "open", F.expr("transform(pool, x -> struct(x.d as d, x.node as node, x.opened or array_contains(open, x.node) as opened))").alias("pool")), "pool")
        reached = chosen.select("query", F.explode("open").alias("node")).join(links, "node").select("query", F.explode("nbrs").alias("node")).distinct()
        known = chosen.select("query", F.explode("pool").alias("x")).select("query", "x.node")
        new = reached.join(known, ["query", "node"], "left_anti").join(vectors, "node").join(asked, "query").select("query", "node", "q", "vector")
        far = new.mapInArrow(distances, "query long, node long, d double").select("query", F.struct("d", "node", F.lit(False).alias("opened")).alias("x"))
        pool = stash(chosen.select("query", F.explode("pool").alias("x")).unionByName(far).groupBy("query").agg(F.slice(F.array_sort(F.collect_list("x")), 1, ef).alias("pool")), "pool")
    return pool.select("query", F.explode("pool").alias("x")).select("query", "x.node", "x.d")


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, ef: int = 400, width: int = 100, rounds: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): of each row whose id is divisible by `every`.

    vectors: vec_id, embedding. Candidates are all rows but the query's own.
    """
    rows = usable(vectors)
    nodes = stash(distinct_nodes(rows, k + 1), "nodes")
    graph = build_graph(nodes)
    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.col("vector").alias("q")).dropDuplicates(["query"])
    asked = stash(asked.join(nodes.select("node", F.col("vector").alias("q")), "q").select("query", "node", "q"), "asked")
    found = search(nodes, graph, asked, ef, width, rounds)
    near = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "node"))), 1, k + 1).alias("near")).select("query", F.explode("near").alias("x"))
    # A pool of k + 1 nodes holds the k nearest rows and more: every node has a row that isn't the query.
    rows_of = near.join(nodes.select("node", "ids"), near["x.node"] == nodes["node"]).select("query", "x.d", F.explode("ids").alias("id")).where("id <> query")
    ranked = rows_of.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k).alias("near")).select("query", F.posexplode("near").alias("at", "x"))
    return ranked.select(F.col("query").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
