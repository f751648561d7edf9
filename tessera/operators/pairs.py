"""Candidate pairs: equi, theta, nearest-neighbour, radius, MinHash and bucket joins. Pairs have a < b."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest
from ..sources.shared import stash


def canonical(pairs: DataFrame, x: str = "a", y: str = "b") -> DataFrame:
    """Distinct unordered pairs of two columns."""
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def all_pairs(records: DataFrame, key: str) -> DataFrame:
    """Every unordered pair: quadratic by its definition; use a block join for anything large."""
    return records.select(F.col(key).alias("a")).join(records.select(F.col(key).alias("b")), F.col("a") < F.col("b"))


def block_join(records: DataFrame, key: str, block: str | Column) -> DataFrame:
    """Distinct pairs that share a block; block may be an array of blocks."""
    block = F.col(block) if isinstance(block, str) else block
    keyed = records.select(F.col(key).alias("k"), block.alias("block"))
    if keyed.schema["block"].dataType.typeName() == "array":
        keyed = keyed.select("k", F.explode(F.array_distinct("block")).alias("block"))
    return keyed.select(F.col("k").alias("a"), "block").join(keyed.select(F.col("k").alias("b"), "block"), "block").where("a < b").select("a", "b").distinct()


#: Rows in a tile of a group, tiles in a block, and blocks of a group that has as many tiles at least.
TILE, BLOCK_TILES, FEW_BLOCKS = 256, 16, 8
#: Pairs worth a task of their own, where there are more than 32 tasks.
TASK_PAIRS = 1 << 18


def tiles(rows: DataFrame, group: str, key: str) -> DataFrame:
    """_g, _t, _rows: a group's rows in the order of their keys, TILE of them at most in an array; rows without group or key are in none.

    A tile's keys are not above those of a tile with a larger _t. No task sorts a whole group.
    """
    packed = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.struct(*(c for c in rows.columns if c != group)).alias("_r"))
    placed = packed.repartitionByRange("_g", "_k").sortWithinPartitions("_g", "_k").withColumn("_t", F.floor(F.monotonically_increasing_id() / F.lit(TILE)))
    return stash(placed.groupBy("_g", "_t").agg(F.collect_list("_r").alias("_rows")), "tiles")


def group_pairs(rows: DataFrame, group: str, key: str) -> DataFrame:
    """x, y, group: structs of the other columns of any two rows of a group, x with the smaller key; equal keys make no pair.

    Tiles of a group are dealt to blocks, and blocks meet in pairs, so that no task has a whole group, however few groups
    there are. Two tiles that meet are one row until they are unfolded last: y goes through a tile in the same order for
    each x, which keeps columnar files of pairs small. The number of partitions is fixed, as adaptive plans go by bytes
    and these grow by rows.
    """
    packed = tiles(rows, group, key)
    of = Window.partitionBy("_g")
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK_TILES), F.least(F.lit(FEW_BLOCKS), F.col("_n"))).cast("int")
    places = packed.select("_g", "_t", F.size("_rows").alias("_size"), F.count("*").over(of).alias("_n"), F.row_number().over(of.orderBy("_t")).alias("_p")).withColumn("_blocks", blocks)
    places = stash(places.select("_g", "_t", "_size", (F.col("_p") % F.col("_blocks")).alias("_own"), "_blocks"), "places")
    groups = places.groupBy("_g").agg(F.first("_blocks").cast("double").alias("_b"), F.sum("_size").cast("double").alias("_n"))
    meets, pairs = groups.agg(F.sum(F.col("_b") * (F.col("_b") + 1) / 2), F.sum(F.col("_n") * (F.col("_n") - 1) / 2)).first()
    parts = int(max(8, min(meets or 0, 2000, max(32, (pairs or 0) // TASK_PAIRS))))
    dealt = packed.join(places.drop("_size"), ["_g", "_t"])
    # One key of all three: a group that a plan knows to be constant would not be a key of both the deal and the join.
    meet = F.concat_ws(",", "_i", "_j", F.col("_g").cast("string")).alias("_m")
    side = lambda r, low, high, mine, other: dealt.withColumn("_o", F.explode(F.sequence(low, high))).select("_g", F.col("_own").alias(mine), F.col("_o").alias(other), F.col("_t").alias(f"{r}t"), F.col("_rows").alias(r))
    left = side("l", F.col("_own"), F.col("_blocks") - 1, "_i", "_j").select(meet, "_g", (F.col("_i") < F.col("_j")).alias("_two"), "lt", "l").repartition(parts, "_m")
    right = side("r", F.lit(0), F.col("_own"), "_j", "_i").select(meet, "rt", "r").repartition(parts, "_m")
    met = left.join(right.hint("shuffle_hash"), "_m").where("_two or lt <= rt")
    first = F.col("lt") <= F.col("rt")
    two = met.select("_g", F.when(first, F.col("l")).otherwise(F.col("r")).alias("xs"), F.when(first, F.col("r")).otherwise(F.col("l")).alias("ys"))
    each = two.select("_g", F.explode("xs").alias("x"), "ys").select("_g", "x", F.explode("ys").alias("y"))
    return each.where(F.col("x")[key] < F.col("y")[key]).select("x", "y", F.col("_g").alias(group))


def intra_cluster(records: DataFrame, key: str, cluster: str) -> DataFrame:
    met = group_pairs(records.select(F.col(key).alias("k"), F.col(cluster).alias("cluster")), "cluster", "k")
    return met.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), "cluster")


#: Rows in a block of hashed pairs, the smallest block worth a task of its own, and blocks of a group that is not larger.
HASH_BLOCK, LEAST_BLOCK = 8192, 256
#: Hashes worth a task of their own, where there are more than 32 tasks.
TASK_HASHES = 1 << 22


def low_hashes(rows: DataFrame, bounds: DataFrame, seed: str) -> DataFrame:
    """cluster, a, b, h: pairs of a cluster whose md5 of seed, a and b is under the bound of the cluster.

    rows: k, cluster. bounds: cluster, bound (8 hex digits at least, or "g" for every pair), blocks, pairs (numbers of both).
    Blocks meet in pairs, where every pair is hashed; those that are low by the first 32 bits are hashed whole.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    meetings, pairs = bounds.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.sum("pairs")).first()
    parts = int(max(8, min(meetings or 0, 2000, max(32, (pairs or 0) // TASK_HASHES))))
    dealt = rows.join(bounds.drop("pairs"), "cluster").withColumn("s", F.col("k").cast("string")).withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "k", "s", "bound")
    head = f"{seed}:".encode()

    def low(table: pa.Table) -> pa.Table:
        table = table.sort_by("k").combine_chunks()
        k, texts, second, bound = table["k"].combine_chunks(), [t.encode() for t in table["s"].to_pylist()], table["second"].to_numpy(), table["bound"][0].as_py()
        # Equal keys have one rank, and make no pair.
        rank = np.r_[0, np.cumsum(pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False))]
        length, limit = np.array([len(t) for t in texts]), int(bound[:8], 16) if bound != "g" else 0xFFFFFFFF
        halves = [(np.arange(len(k)),) * 2] if table["i"][0] == table["j"][0] else [(np.flatnonzero(~second), np.flatnonzero(second)), (np.flatnonzero(second), np.flatnonzero(~second))]
        found = []
        for left, right in halves:
            for m in np.unique(length[left]):
                for n in np.unique(length[right]):
                    x, y = left[length[left] == m], right[length[right] == n]
                    start = np.searchsorted(rank[y], rank[x], side="right")
                    if len(head) + m + 1 + n <= digest.MOST_BYTES:
                        prefix = np.frombuffer(b"".join(head + texts[i] + b":" for i in x), np.uint8).reshape(len(x), -1)
                        met = digest.low_pairs(prefix, start, np.frombuffer(b"".join(texts[j] for j in y), np.uint8).reshape(len(y), -1), limit)
                        met = zip(x[met[0]].tolist(), y[met[1]].tolist(), strict=True)
                    else:
                        met = ((i, j) for i, f in zip(x.tolist(), start.tolist(), strict=True) for j in y[f:].tolist())
                    hashed = ((i, j, hashlib.md5(head + texts[i] + b":" + texts[j]).hexdigest()) for i, j in met)
                    found += [z for z in hashed if z[2] < bound]
        a, b, h = zip(*found, strict=True) if found else ((), (), ())
        at = lambda z: k.take(pa.array(z, pa.int64()))
        return pa.table({"cluster": pa.array([table["cluster"][0].as_py()] * len(a), table.schema.field("cluster").type), "a": at(a), "b": at(b), "h": pa.array(h, pa.string())})

    met = meets.repartition(parts, "cluster", "i", "j").groupBy("cluster", "i", "j")
    return met.applyInArrow(low, f"cluster {kinds['cluster']}, a {kinds['k']}, b {kinds['k']}, h string")


def lowest_pairs(records: DataFrame, key: str, cluster: str, most: int, seed: str = "42") -> DataFrame:
    """cluster, a, b: of all pairs of a cluster the `most` of smallest md5 of seed, a and b.

    Every pair is hashed, but only hashes under a bound that three times as many are expected to pass
    are kept. A cluster with too few of them is done again with a larger bound, in the end without one.
    """
    rows = records.select(F.col(key).alias("k"), F.col(cluster).alias("cluster")).where("k is not null and cluster is not null")
    digits, factor, n = 13, 3, F.col("n")
    blocks = F.greatest(F.ceil(n / HASH_BLOCK), F.least(F.lit(FEW_BLOCKS), F.ceil(n / LEAST_BLOCK))).cast("int")
    todo = rows.groupBy("cluster").agg(F.count("*").cast("double").alias("n")).select("cluster", (n * (n - 1) / 2).alias("pairs"), blocks.alias("blocks"))
    found = None
    while True:
        part = (F.lit(float(factor * most * 16**digits)) / F.col("pairs")).cast("long")
        # "g" is over every hash.
        bound = F.when(F.col("pairs") <= factor * most, "g").otherwise(F.lpad(F.lower(F.hex(part)), digits, "0"))
        bounds = stash(todo.withColumn("bound", bound), "bounds")
        low = stash(low_hashes(rows, bounds, seed), "low")
        counts = low.groupBy("cluster").agg(F.count("*").alias("n"))
        short = stash(bounds.where("bound <> 'g'").join(counts, "cluster", "left").where(F.coalesce("n", F.lit(0)) < most).select("cluster", "pairs", "blocks"), "short")
        done = short.isEmpty()
        low = low if done else low.join(short, "cluster", "left_anti")
        found = low if found is None else found.unionByName(low)
        if done:
            break
        todo, factor = short, factor * 64
    return found.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("h", "a", "b"))).where(F.col("k") <= most).select("cluster", "a", "b")


def cross_cluster(records: DataFrame, key: str, cluster: str) -> DataFrame:
    a = records.select(F.col(key).alias("a"), F.col(cluster).alias("ca"))
    b = records.select(F.col(key).alias("b"), F.col(cluster).alias("cb"))
    return a.join(b, F.col("ca") < F.col("cb"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


#: Rows in a block of vectors; a task holds two blocks.
BLOCK = 4096


def vector_pairs(vectors: DataFrame, measure: str, blocks: int | None = None, most: int | None = None, within: float | None = None) -> DataFrame:
    """src, nbr, dist of other vectors: the `most` nearest of each, or all `within` a distance; exact.

    vectors: id, vector (of one length; null vectors take no part). Blocks of BLOCK rows or so meet in
    pairs as matrix products, which choose with a margin; distances that count are computed from the
    vectors themselves, so that they don't depend on blocks. Each task keeps `most` rows a source
    before the shuffle. measure: l2 or cosine.
    """
    vectors = vectors.where("vector is not null")
    blocks = blocks or max(8, -(-vectors.count() // BLOCK))
    dealt = vectors.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    left = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.concat_ws("-", "block", "other").alias("meet"), F.lit(0).alias("side"), "id", "vector")
    right = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.concat_ws("-", "other", "block").alias("meet"), F.lit(1).alias("side"), "id", "vector")

    def near(table: pa.Table) -> pa.Table:
        side, ids, x = table.column("side").to_numpy(), table.column("id").to_numpy(), _matrix(table.column("vector"))
        a, b, u, v = ids[side == 0], ids[side == 1], x[side == 0], x[side == 1]
        out = ([], [], [])
        long_u, long_v = (u * u).sum(1), (v * v).sum(1)
        for i in range(0, len(a), 256):
            own, long = u[i : i + 256], long_u[i : i + 256]
            if measure == "cosine":
                n = np.sqrt(long)[:, None] * np.sqrt(long_v)
                rough, margin = 1 - np.divide(own @ v.T, n, out=np.zeros_like(n), where=n > 0), 1e-9
            else:
                # Squares, with a margin for what the sum cancels.
                rough, margin = long[:, None] + long_v - 2 * own @ v.T, 1e-9 * (long.max(initial=0) + long_v.max(initial=0))
            rough[a[i : i + 256, None] == b] = np.inf
            keep = np.isfinite(rough)
            if most is not None and most < rough.shape[1]:
                # Ties at the border stay in, so that the smaller id can win later.
                keep &= rough <= np.partition(rough, most - 1, axis=1)[:, most - 1 : most] + margin
            if within is not None:
                keep &= rough <= (within if measure == "cosine" else within * within) + margin
            rows, cols = np.nonzero(keep)
            for k in range(0, len(rows), 1 << 14):
                x, y = rows[k : k + (1 << 14)], cols[k : k + (1 << 14)]
                if measure == "cosine":
                    n = np.sqrt(long[x] * long_v[y])
                    d = 1 - np.divide((own[x] * v[y]).sum(1), n, out=np.zeros_like(n), where=n > 0)
                else:
                    d = np.sqrt(((own[x] - v[y]) ** 2).sum(1))
                ok = d <= within if within is not None else np.ones(len(d), bool)
                for o, z in zip(out, (a[i + x[ok]], b[y[ok]], d[ok]), strict=True):
                    o.append(z)
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0), t)
        return pa.table({"src": cat(out[0], pa.int64()), "nbr": cat(out[1], pa.int64()), "dist": cat(out[2], pa.float64())})

    found = left.unionByName(right).groupBy("meet").applyInArrow(near, "src long, nbr long, dist double")
    return found if most is None else ranked(found).where(F.col("rank") <= most).drop("rank")


def ranked(found: DataFrame) -> DataFrame:
    """found (src, nbr, dist) with rank from 1, ties to smaller ids."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dist", "nbr")))


def variance_dimensions(vectors: DataFrame, top: int = 20) -> DataFrame:
    """dim, variance (population) of the `top` dimensions of largest variance."""
    each = vectors.select(F.posexplode("vector").alias("dim", "x"))
    return each.groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance")).orderBy(F.desc("variance"), "dim").limit(top)


#: Rows in a block of cells; two blocks' pairs are the result of a group.
BUCKET_BLOCK = 2048


def bucket_pairs(vectors: DataFrame, top: int = 20, scale: int = 20, shared: int = 3) -> DataFrame:
    """a, b, n of pairs that share floor(x * scale) in at least `shared` of the `top` dimensions of largest variance."""
    # `top` rows.
    dims = [r["dim"] for r in variance_dimensions(vectors, top).select("dim").collect()]
    cells = vectors.where("id is not null and vector is not null").select("id", F.array(*(F.floor(F.get("vector", F.lit(i)).cast("double") * scale) for i in dims)).cast("array<long>").alias("cells"))
    blocks = max(8, -(-cells.count() // BUCKET_BLOCK))
    # Blocks meet in pairs and shared cells are counted there: a pair is a row only if it counts.
    dealt = cells.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    meets = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "id", "cells").repartition(min(1000, blocks * (blocks + 1) // 2), "i", "j")

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, second, same = table.column("id").to_numpy(), table.column("second").to_numpy(), table.column("i")[0] == table.column("j")[0]
        flat = table.column("cells").combine_chunks().flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        value = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        codes = np.stack([np.unique(c, return_inverse=True)[1] for c in value.T]).astype(np.int16 if len(ids) < 1 << 15 else np.int32) if len(dims) else np.zeros((0, len(ids)), np.int16)
        left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        # What is missing on one side has a code that the other side doesn't use.
        u, v = np.where(known.T, codes, -1)[:, left], np.where(known.T, codes, -2)[:, right]
        starts = lambda at: np.flatnonzero(np.r_[True, ids[at][1:] != ids[at][:-1]]) if len(at) else np.zeros(0, int)
        rows, cols = starts(left), starts(right)
        out = ([], [], [])
        for k in range(0, len(rows), 256):
            begin, end = rows[k], rows[k + 256] if k + 256 < len(rows) else len(left)
            n = np.zeros((end - begin, len(right)), np.uint8 if top < 256 else np.int64)
            for x, y in zip(u[:, begin:end], v, strict=True):
                n += x[:, None] == y
            if len(rows) < len(left) or len(cols) < len(right):
                # Rows of one id count together.
                n = np.add.reduceat(np.add.reduceat(n.astype(np.int64), cols, axis=1), rows[k : k + 256] - begin, axis=0) if len(cols) else n
            x, y = np.nonzero(n >= shared)
            a, b = ids[left[rows[k + x]]], ids[right[cols[y]]]
            keep = a < b if same else a != b
            for o, z in zip(out, (np.minimum(a, b)[keep], np.maximum(a, b)[keep], n[x, y][keep]), strict=True):
                o.append(z)
        return pa.table({c: pa.array(np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64)) for c, o in zip(("a", "b", "n"), out, strict=True)})

    return meets.groupBy("i", "j").applyInArrow(count, "a long, b long, n long")


def minhash_pairs(sets: DataFrame, bands: int = 16, rows: int = 4) -> DataFrame:
    """a, b of records (id, items: array of strings) that agree on a band of MinHash values; equal sets meet through one of them."""
    # Equal sets are one node, so that a group of copies makes as many pairs as it has members.
    keyed = sets.where("size(items) > 0").withColumn("h", F.sha2(F.array_join(F.array_sort("items"), "\x1f"), 256))
    node = keyed.groupBy("h").agg(F.min("id").alias("rep"), F.first("items").alias("items"))
    copies = keyed.join(node.select("h", "rep"), "h").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    least = lambda k: F.array_min(F.transform("items", lambda x: F.xxhash64(F.lit(k), x)))
    band = [F.sha2(F.concat_ws(",", F.lit(i), *(least(i * rows + j) for j in range(rows))), 256) for i in range(bands)]
    alike = block_join(node.select("rep", F.array(*band).alias("bands")), "rep", "bands")
    return alike.unionByName(copies)


def token_jaccard(sets: DataFrame, least: float) -> DataFrame:
    """a, b, jaccard of records (id, items) that share enough items: an equi-join on items, with sizes to finish."""
    each = sets.select("id", F.explode(F.array_distinct("items")).alias("item"), F.size(F.array_distinct("items")).alias("n"))
    met = each.select(F.col("id").alias("a"), "item", F.col("n").alias("na")).join(each.select(F.col("id").alias("b"), "item", F.col("n").alias("nb")), "item").where("a < b and na >= nb * {0} and nb >= na * {0}".format(least))
    return met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k")).select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard")).where(F.col("jaccard") >= least)


def updated(scores: DataFrame, corrections: DataFrame, soft: float = 0.0) -> DataFrame:
    """scores (a, b, p) overwritten by corrections (a, b, same): 1 for matches, `soft` for others."""
    told = corrections.select("a", "b", F.when(F.col("same"), 1.0).otherwise(soft).alias("told"))
    return scores.join(told, ["a", "b"], "left").withColumn("p", F.coalesce("told", "p")).drop("told")


def overlaid(old: DataFrame, new: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Old scores that are sure (at most low, at least high), else new ones."""
    both = old.select("a", "b", F.col("p").alias("old")).join(new.select("a", "b", F.col("p").alias("new")), ["a", "b"], "full")
    sure = (F.col("old") <= low) | (F.col("old") >= high)
    return both.select("a", "b", F.when(sure, F.col("old")).otherwise(F.coalesce("new", "old")).alias("p"))


def scorer(function, batch: int = 20):
    """A mapInPandas function that gives function (a pandas frame of at most `batch` pairs to a list of scores) its batches."""

    def score(frames: Iterator) -> Iterator:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield part.assign(score=[float(x) for x in function(part)])

    return score
