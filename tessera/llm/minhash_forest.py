"""Near-duplicate detection with a MinHash LSH forest.

A text's set is its distinct shingles of `width` words (the whole word sequence, if there
are fewer). Texts of equal sets are one class; a class is represented by its smallest
doc_id, so groups of exact copies cost one signature however large they are.

Each of TREES trees orders all classes by DEPTH MinHash values. The order is a range sort:
a region of texts that agree on many values is split over tasks like any other. In sorted
order, the NEAR following classes that agree on the first LEAST values are candidates;
where a region is crowded, the nearest in order are those with the longest common prefix,
so the depth adapts to the region. A sketch of one bit of each of BITS MinHash values travels
along; candidates whose bits agree too rarely are left out (by five standard deviations).

Candidates are confirmed on full sets: first the best one of each class, then, of all
others, those that the confirmed links have not connected already. Components follow by
stars.

Regions of equal first LEAST values with more than NEAR + 1 classes, and those at the border
of a partition, are finished: all their pairs that are not connected yet are compared by
sketch and confirmed, in blocks of BLOCK classes that are dealt over tasks. So a pair at the
threshold is missed with a probability below 10**-6, in crowds as well.

Edge cases: null and empty texts, and texts without words, have no set and are linked with
nothing; a null doc_id is linked with nothing and kept; rows that repeat, id included, are
in one class and share its component; ties of similarity go to smaller ids; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .components import components
from .shared import small_batches, stash

TREES, LEAST, DEPTH, NEAR = 20, 3, 6, 4
VALUES, BITS = TREES * LEAST, 240
#: Bytes of a value in a key: three of the first LEAST, two of deeper ones.
PREFIX = 1 + 3 * LEAST
MULTIPLIERS = np.random.default_rng(77).integers(0, 1 << 63, BITS, dtype=np.uint64) * K.U64(2) + K.U64(1)
#: Classes of a crowded region in a block; a task compares two blocks at a time.
BLOCK = 256
HOT_ROWS, HOT_CLASSES = 1_000, 10_000
#: Texts are looked up by a bitmap of so many bits (4 MB), which bounds what is broadcast; more documents only make it less selective.
BITMAP = 1 << 25


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin (with the end)."""
    words = K.of_column(text, K.SPACE, True)
    at, h = words.windows(width)
    cuts = np.searchsorted(at, words.first)
    counts = words.counts
    short = (counts > 0) & (counts < width)
    whole = K.RangeHash(words.hash, 0x2545F4914F6CDD1D).of(words.first[:-1], words.first[1:])
    sets = [np.unique(h[a:b]) if b > a else whole[i : i + 1] if short[i] else h[:0] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]
    return np.concatenate([*sets, h[:0]]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1, h2 (two hashes of the set), signature (VALUES big-endian 32-bit minima, then a bit of each of BITS minima)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                sets, cuts = shingle_sets(part.column("text"), width)
                n = np.diff(cuts)
                full = np.flatnonzero(n)
                heads = cuts[:-1][full]
                out, bits = np.zeros((part.num_rows, VALUES), dtype=">u4"), np.zeros((part.num_rows, BITS), dtype=bool)
                sums = np.zeros((2, part.num_rows), dtype=np.uint64)
                if len(full):
                    for i, m in enumerate(MULTIPLIERS):
                        low = np.minimum.reduceat(sets * m, heads)
                        bits[full, i] = K.mixed(low) & K.U64(1)
                        if i < VALUES:
                            out[full, i] = low >> K.U64(32)
                    sums[0, full] = np.add.reduceat(K.mixed(sets), heads)
                    sums[1, full] = np.add.reduceat(K.mixed(sets ^ K.U64(0xA0761D6478BD642F)), heads)
                signatures = [r.tobytes() + b.tobytes() if k else None for r, b, k in zip(out, np.packbits(bits, axis=1), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(signatures, pa.binary())], ["doc_id", "text_hash", "n_shingles", "h1", "h2", "signature"])
            K.give_back()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, f"doc_id {kind}, text_hash long, n_shingles long, h1 long, h2 long, signature binary")


def regions(keys: np.ndarray) -> np.ndarray:
    """A hash of the tree and its first LEAST values, for keys by row."""
    h = keys[:, 0].astype(np.uint64)
    for i in range(1, PREFIX, 3):
        v = keys[:, i : i + 3].astype(np.uint64)
        h = K.mixed(h ^ (v[:, 0] << K.U64(16) | v[:, 1] << K.U64(8) | v[:, 2]))
    return h


def regions_of(signatures: list[bytes]) -> np.ndarray:
    """The regions of each signature, a row of TREES."""
    n = len(signatures)
    values = np.frombuffer(b"".join(signatures), np.uint8).reshape(n, VALUES * 4 + BITS // 8)[:, : VALUES * 4].reshape(n, TREES, LEAST, 4)
    keys = np.concatenate([np.broadcast_to(np.arange(TREES, dtype=np.uint8)[:, None], (n, TREES, 1)), values[..., :3].reshape(n, TREES, 3 * LEAST)], 2)
    return regions(keys.reshape(n * TREES, PREFIX)).reshape(n, TREES)


def region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """region, rep of each class and tree."""
    for batch in batches:
        if batch.num_rows:
            found = regions_of(batch.column("signature").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), TREES))], ["region", "rep"])
    K.give_back()


def forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key (tree and DEPTH values, cut short), rep, sketch of each class and tree."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        whole = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(n, VALUES * 4 + BITS // 8)
        values = whole[:, : VALUES * 4].reshape(n, VALUES, 4)
        sketch = pa.array([r.tobytes() for r in whole[:, VALUES * 4 :]], pa.binary())
        for t in range(TREES):
            own = [values[:, (t * LEAST + i) % VALUES, : 3 if i < LEAST else 2] for i in range(DEPTH)]
            keys = np.concatenate([np.full((n, 1), t, np.uint8), *own], 1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in keys], pa.binary()), batch.column("rep"), sketch], ["key", "rep", "sketch"])
        K.give_back()


def neighbours(least: float):
    """From rows in sorted order: a, b, agree for classes near each other with a common prefix and alike sketches;
    and region, alone in its row, for regions that this leaves unfinished."""

    def unfinished(keys: np.ndarray) -> pa.RecordBatch:
        r = pa.array(np.unique(regions(keys)).view(np.int64))
        none = pa.nulls(len(r), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(r), pa.float64()), r], ["a", "b", "agree", "region"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            reps = batch.column("rep").to_numpy()
            if held is not None:
                keys, sketch, reps = (np.concatenate([x, y]) for x, y in zip(held, (keys, sketch, reps), strict=True))
            else:
                yield unfinished(keys[:1])
            old = 0 if held is None else len(held[2])
            i = np.arange(max(old, NEAR + 1), len(reps))
            i = i[(keys[i, :PREFIX] == keys[i - NEAR - 1, :PREFIX]).all(1)]
            if len(i):
                yield unfinished(keys[i])
            found = []
            for lag in range(1, min(NEAR, len(reps) - 1) + 1):
                i = np.arange(max(old, lag), len(reps))
                i = i[(keys[i, :PREFIX] == keys[i - lag, :PREFIX]).all(1) & (reps[i] != reps[i - lag])]
                agree = 1 - np.bitwise_count(sketch[i] ^ sketch[i - lag]).sum(1) / BITS
                ok = agree >= least
                found.append((np.minimum(reps[i], reps[i - lag])[ok], np.maximum(reps[i], reps[i - lag])[ok], agree[ok]))
            if found:
                a, b, agree = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.float64()), pa.nulls(len(a), pa.int64())], ["a", "b", "agree", "region"])
            held = keys[-NEAR - 1 :], sketch[-NEAR - 1 :], reps[-NEAR - 1 :]
        if held is not None:
            yield unfinished(held[0][-1:])
        K.give_back()

    return scan


def confirmer(width: int, percent: int):
    """Keeps the pairs (a, b, za, zb: compressed texts) with 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = [], []
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [unzip.decompress(z) for pair in zip(part.column("za").to_pylist(), part.column("zb").to_pylist(), strict=True) for z in pair]
                sets, cuts = shingle_sets(pa.array(texts, pa.binary()), width)
                for k, (x, y) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                    one, two = sets[cuts[2 * k] : cuts[2 * k + 1]], sets[cuts[2 * k + 1] : cuts[2 * k + 2]]
                    both = np.sort(np.concatenate([one, two]))
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            K.give_back()

    return confirm


def crowd_linker(width: int, percent: int, least: float):
    """Links (a, b) between the classes of two blocks of a region (or within one) that connect all that are alike enough.

    A pair counts in the first of its common regions only, which is unfinished too, or has compared it already.
    """

    def link(table: pa.Table) -> pa.Table:
        out = ([], [])
        i, j, region = (table.column(c)[0].as_py() for c in ("i", "j", "region"))
        own, reps, labels = (table.column(c).to_numpy() for c in ("own", "rep", "label"))
        signatures = table.column("signature").to_pylist()
        found = regions_of(signatures).view(np.int64)
        sketch = np.zeros((len(reps), (BITS + 63) // 64 * 8), np.uint8)
        sketch[:, : BITS // 8] = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(reps), -1)[:, VALUES * 4 :]
        sketch = sketch.view(np.uint64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        pairs = []
        for k in range(0, len(left), 64):
            rows = left[k : k + 64]
            agree = 1 - np.bitwise_count(sketch[rows, None] ^ sketch[None, right]).sum(2, dtype=np.int64) / BITS
            ok = (agree >= least) & (labels[rows, None] != labels[None, right])
            if i == j:
                ok &= rows[:, None] < right[None]
            x, y = np.nonzero(ok)
            agree, x, y = agree[x, y], rows[x], right[y]
            same = found[x] == found[y]
            ok = found[x, same.argmax(1)] == region
            ok &= same.any(1)
            pairs.append((agree[ok], x[ok], y[ok]))
        agree, x, y = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0), left[:0], left[:0])
        if len(x):
            used = np.unique(np.concatenate([x, y]))
            unzip = zstandard.ZstdDecompressor()
            sets, cuts = shingle_sets(pa.array([unzip.decompress(z) for z in table.column("z").take(pa.array(used)).to_pylist()], pa.binary()), width)
            n = np.diff(cuts)
            x, y = np.searchsorted(used, x), np.searchsorted(used, y)
            # Sizes alone rule a pair out where the smaller set is below its share of the larger.
            ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            order = np.flatnonzero(ok)[np.argsort(-agree[ok], kind="stable")]
            root = {v: v for v in labels[used].tolist()}
            label, ids = labels[used].tolist(), reps[used].tolist()

            def find(v: int) -> int:
                while root[v] != v:
                    root[v] = v = root[root[v]]
                return v

            for p, q in zip(x[order].tolist(), y[order].tolist(), strict=True):
                u, v = find(label[p]), find(label[q])
                if u == v:
                    continue
                both = np.sort(np.concatenate([sets[cuts[p] : cuts[p + 1]], sets[cuts[q] : cuts[q + 1]]]))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    root[u] = v
                    out[0].append(ids[p])
                    out[1].append(ids[q])
        K.give_back()
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return link


def crowd_links(docs: DataFrame, reps: DataFrame, label: DataFrame, unfinished: DataFrame, width: int, percent: int, least: float) -> DataFrame:
    """a, b: links between classes of unfinished regions (region) that label (rep, component) has not connected."""
    labelled = reps.join(label, "rep", "left").select("rep", F.coalesce("component", "rep").alias("label"), "signature")
    members = reps.select("rep", "signature").mapInArrow(region_rows, "region long, rep long").join(unfinished, "region")
    crowd = stash(members.join(labelled.select("rep", "label"), "rep"), "crowd")
    # The largest group of connected classes meets the others only; its own pairs need nothing.
    each = crowd.groupBy("region", "label").agg(F.count("*").alias("n"))
    sizes = each.groupBy("region").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK)
    shape = sizes.select("region", F.col("top.label").alias("top"), blocks(F.col("top.n")).alias("tops"), blocks(F.col("n") - F.col("top.n")).alias("others"))
    own = F.when(F.col("label") == F.col("top"), F.pmod(F.xxhash64("rep"), "tops")).otherwise(F.col("tops") + F.pmod(F.xxhash64("rep"), "others"))
    first = F.when(F.col("label") == F.col("top"), F.col("tops")).otherwise(F.lit(0))
    dealt = stash(crowd.join(shape, "region").select("region", "rep", "label", own.alias("own"), first.alias("first"), (F.col("tops") + F.col("others") - 1).alias("last")), "dealt")
    texts = texts_of(docs, dealt.select(F.col("rep").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "rep")
    whole = stash(texts.join(reps.select("rep", "signature"), "rep"), "members")
    met = dealt.join(whole, "rep").withColumn("other", F.explode(F.sequence("first", "last")))
    met = met.select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label", "signature", "z")
    return stash(met.groupBy("region", "i", "j").applyInArrow(crowd_linker(width, percent, least), "a long, b long").distinct(), "links")


def bitmap_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, of fixed size, aggregated in Spark; a set bit says that an id may be among ids."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)) + 1  # positions count from 1
    parts = ids.groupBy(F.bitmap_bucket_number(h).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits")).collect()
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in parts:
        at = (r["part"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "z"])
        K.give_back()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, z (compressed text) of the documents with these ids; a bitmap keeps most others out of the shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            yield batch.filter(pa.array((held.value[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool))).select(["doc_id", "text"])

    hashed = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).alias("h"))
    found = hashed.mapInArrow(lambda batches: zipped(maybe(batches)), "doc_id long, z binary").join(ids, "doc_id", "left_semi")
    # Equal ids have equal texts up to copies of a row; one of them is enough.
    return found.dropDuplicates(["doc_id"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, text_hash (xxhash64), for each row of docs.

    docs: doc_id (integer), text. Links: pairs with 100 * intersection >= percent * union. Of rows
    with one id and different texts each is judged by its own text, and text_hash tells them apart.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = stash(signed(docs, width), "signatures")
    classes = signatures.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.count("*").alias("rows"))
    reps = stash(classes, "classes")
    share = percent / 100
    agree = (1 + share) / 2
    least = agree - 5 * (agree * (1 - agree) / BITS) ** 0.5
    rows = reps.select("rep", "signature").mapInArrow(forest_rows, "key binary, rep long, sketch binary")
    found = rows.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep").mapInArrow(neighbours(least), "a long, b long, agree double, region long")
    found = stash(found, "found")
    pairs = stash(found.where("region is null").groupBy("a", "b").agg(F.max("agree").alias("agree")), "candidates")

    texts = stash(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "texts")

    def confirmed(chosen: DataFrame) -> DataFrame:
        with_texts = chosen.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b")
        return stash(with_texts.select("a", "b", "za", "zb").mapInArrow(confirmer(width, percent), "a long, b long"), "links")

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a"))
    links = confirmed(best)
    linked = components(links)
    place = lambda x: linked.select(F.col("node").alias(x), F.col("component").alias(f"{x}_at"))
    rest = (
        pairs.join(best, ["a", "b"], "left_anti").join(place("a"), "a", "left").join(place("b"), "b", "left")
        .where(F.coalesce("a_at", "a") != F.coalesce("b_at", "b"))
    )
    links = links.unionByName(confirmed(rest))
    label = components(links).withColumnRenamed("node", "rep")
    more = crowd_links(docs, reps, label, found.where("region is not null").select("region").distinct(), width, percent, least)
    if not more.isEmpty():
        label = components(links.unionByName(more)).withColumnRenamed("node", "rep")
    # A class of many rows (HOT_ROWS and a share of 1 in HOT_CLASSES at least, so HOT_CLASSES classes at most) is broadcast, not shuffled to.
    total = reps.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") > max(HOT_ROWS, total // HOT_CLASSES)
    owner = stash(reps.join(label, "rep", "left").select("h1", "h2", "n_shingles", "rows", F.coalesce("component", "rep").alias("component")), "owners")
    rows = signatures.select("doc_id", "n_shingles", "h1", "h2", "text_hash")
    key = ["h1", "h2", "n_shingles"]
    met = rows.where("n_shingles > 0").join(F.broadcast(owner.where(hot).select(*key, "component")), key, "left")
    known, others = met.where("component is not null"), met.where("component is null").drop("component").join(owner.where(~hot).select(*key, "component"), key, "left")
    found = known.select(*others.columns).unionByName(others).unionByName(rows.where("n_shingles = 0").withColumn("component", F.col("doc_id")))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"), "text_hash")
