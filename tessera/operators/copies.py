"""Groups of near copies of sets: MinHash bands as blocks, Jaccard on whole sets, components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stash
from .graph import components, labels

#: Rounds in which a block is a star around one member; what is not connected after them is compared in all pairs.
STARS = 2


def signer(bands: int, rows: int):
    """A mapInArrow function: id, n, h and hashes (of a set's items) to id, n, h, a value for each band and a sketch (a byte of each minimum)."""
    rng = np.random.default_rng(96)
    mul, add = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1) for _ in range(2))
    place = np.arange(bands, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("hashes")
            ends, x = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            out, sketch = np.empty((batch.num_rows, bands), np.uint64), []
            for k in range(batch.num_rows):
                low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for i in range(ends[k], ends[k + 1], 2048):
                    mixed = x[i : min(i + 2048, ends[k + 1])] * mul + add
                    low = np.minimum(low, (mixed ^ (mixed >> np.uint64(31))).min(axis=1))
                value = place.copy()
                for m in low.reshape(bands, rows).T:
                    value = (value ^ m) * np.uint64(0x9E3779B97F4A7C15)
                    value ^= value >> np.uint64(29)
                out[k] = value
                sketch.append(low.astype(np.uint8).tobytes())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, bands), pa.int32()), pa.array(out.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("h"), flat, pa.array(sketch, pa.binary())], ["id", "n", "h", "bands", "sketch"])

    return sign


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z = pa.array([zlib.compress(t.as_buffer(), 1) for t in batch.column("t")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), z], ["id", "z"])


def alike(least: float):
    """A mapInArrow function: a, b, sa, sb to those a, b whose sketches agree as often as sets with a Jaccard of `least` do, less five standard deviations."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                batch = batch.filter(pa.array((u == v).mean(axis=1) >= least - 5 * (least * (1 - least) / u.shape[1]) ** 0.5))
            yield batch.select(["a", "b"])

    return filtered


def confirmer(least: float):
    """A mapInArrow function: a, b, za, zb to those a, b whose sets have a Jaccard of at least `least`."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, set()
            for za, zb in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True):
                if za != last:
                    last, x = za, set(zlib.decompress(za).split(b"\n"))
                y = set(zlib.decompress(zb).split(b"\n"))
                k = len(x & y)
                keep.append(k / (len(x) + len(y) - k) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def near_copies(sets: DataFrame, least: float, bands: int = 24, rows: int = 4) -> DataFrame:
    """id, label of every row of sets (id: integer, items: distinct strings without line breaks): the smallest id reachable over pairs that share a band and have a Jaccard of at least `least`.

    Equal sets are one node. Pairs that are connected already need no comparison: each block is first a
    star around one member, in a few rounds with other members as centres, and only members in different
    components are compared in all pairs at the end. Pairs whose minima agree far too seldom (five standard
    deviations: 3 in ten million at the threshold) are not compared. Items go through a shuffle compressed, and only
    those of sets that share a band with another.
    """
    sets = sets.select(F.col("id").cast("long").alias("id"), "items")
    whole = sets.where("id is not null and size(items) > 0").withColumn("t", F.array_join(F.array_sort("items"), "\n"))
    hashed = whole.select("id", F.size("items").cast("long").alias("n"), F.unhex(F.sha2("t", 256)).alias("h"), F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    signed = stash(hashed.mapInArrow(signer(bands, rows), "id long, n long, h binary, bands array<long>, sketch binary"), "signed")
    node = stash(signed.groupBy("h").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    links = stash(signed.select("id", "h").join(node.select("h", "rep"), "h").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")), "copies")

    keyed = node.select(F.explode("bands").alias("band"), F.col("rep").alias("id"), "n")
    shared = keyed.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    block = stash(keyed.join(shared, "band"), "blocks")
    ids = block.select("id").distinct()
    texts = whole.select("id", F.col("t").cast("binary").alias("t")).mapInArrow(packed, "id long, z binary")
    texts = stash(texts.join(ids, "id", "left_semi"), "texts")
    at = lambda x: texts.select(F.col("id").alias(x), F.col("z").alias(f"z{x}"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").join(at("a"), "a").join(at("b"), "b")
        return stash(both.select("a", "b", "za", "zb").mapInArrow(confirmer(least), "a long, b long"), "links")

    def likely(pairs: DataFrame) -> DataFrame:
        sketch = lambda x: node.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"))
        return pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "sa", "sb").mapInArrow(alike(least), "a long, b long").distinct()

    tried = None
    fits = f"least(na, nb) >= {least - 1e-9} * greatest(na, nb)"
    for turn in range(STARS + 1):
        placed = block.withColumn("at", F.col("id")) if turn == 0 else block.join(components(links).select(F.col("node").alias("id"), "component"), "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("at"))
        # Blocks of one component are done.
        open_ = placed.groupBy("band").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.min(F.struct((F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))).alias("o"), "id", "n", "at")).alias("c")).where("lo < hi")
        if turn < STARS:
            met = placed.join(open_.select("band", "c"), "band").select(F.col("id").alias("x"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("c.id").alias("y"), F.col("c.n").alias("nb"), F.col("c.at").alias("pb"))
        else:
            rest = stash(placed.join(open_.select("band"), "band", "left_semi"), "open")
            met = rest.select("band", F.col("id").alias("x"), F.col("n").alias("na"), F.col("at").alias("pa")).join(rest.select("band", F.col("id").alias("y"), F.col("n").alias("nb"), F.col("at").alias("pb")), "band").where("x < y")
        fresh = met.where(f"pa <> pb and {fits}").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tried is not None:
            fresh = fresh.join(tried, ["a", "b"], "left_anti")
        fresh = stash(likely(fresh), "pairs")
        if fresh.isEmpty() and turn < STARS:
            continue
        links = links.unionByName(confirmed(fresh))
        tried = fresh if tried is None else tried.unionByName(fresh)
    return labels(sets, links)
