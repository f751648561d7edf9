"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of hashed words, word pairs and word pairs with one
word between. Training follows per-coordinate learning rates with L1 sparsity; it uses a
bounded sample of labelled rows (`sample`, the rows of smallest hash), since the weights'
quality depends on the number of labels and not on the size of the corpus. One task learns,
since each step needs the last; its rows come sorted, epoch after epoch, as a stream, so it
holds the weights and a batch (a row has 2**BITS features at most). The weights
that L1 leaves are few (at most 2**BITS) and broadcast; every text is scored whole.

Edge cases: null and empty texts have no features and get the bias alone; labels that are
null are not used, of several labels of an id the largest is; rows that repeat are learnt
from and scored each (equal ids in order of their features, so that weights don't depend on
the shuffle); an empty table gives an empty result; without any label every score is 0.5.
Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import small_batches, stash, with_fields

BITS = 20
KINDS = ((0x9E3779B97F4A7C15, 1), (0xC2B2AE3D27D4EB4F, 2))


def features(words: K.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word positions and feature numbers: words, then pairs at distance 1 and 2."""
    mask, h = K.U64((1 << BITS) - 1), words.hash
    yield np.arange(len(h)), (h & mask).astype(np.int32)
    left = words.left()
    for salt, gap in KINDS:
        at = np.flatnonzero(left > gap)
        yield at, (K.mixed(h[at] * K.U64(salt) + h[at + gap]) & mask).astype(np.int32)


def by_text(batch: pa.RecordBatch) -> list[np.ndarray]:
    words = K.of_column(batch.column("text"), K.NOT_ALNUM, True)
    found = list(features(words))
    row = np.concatenate([np.searchsorted(words.first, at, "right") - 1 for at, _ in found])
    both = np.unique((row.astype(np.int64) << BITS) | np.concatenate([f for _, f in found]))
    cuts = np.searchsorted(both, np.arange(batch.num_rows + 1, dtype=np.int64) << BITS)
    values = (both & ((1 << BITS) - 1)).astype(np.int32)
    return [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Ftrl:
    """FTRL-proximal with a bias that isn't regularised."""

    def __init__(self, alpha: float = 3.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias = np.zeros(2)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def bias_weight(self) -> float:
        return float(-self.bias[0] / ((self.beta + np.sqrt(self.bias[1])) / self.alpha))

    def learn(self, at: np.ndarray, y: int) -> None:
        w, b = self.weights(at), self.bias_weight()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        root = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (root - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g
        root = np.sqrt(self.bias[1] + g * g)
        self.bias += (g - (root - np.sqrt(self.bias[1])) / self.alpha * b, g * g)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, epochs: int = 4) -> list[tuple[int, float]]:
    """The non-zero weights as (feature, weight); feature -1 is the bias.

    docs: doc_id, text. labels: doc_id, label (0 or 1), of rows that may be learnt from.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample is bounded by its parameter, so it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                names = part.column("doc_id").cast(pa.string())
                order = pa.array([hash_of(x) for x in names.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([names, order, part.column("label"), pa.array([packed(x) for x in by_text(part)], pa.binary())], ["id", "place", "label", "features"])
            K.give_back()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, any_row = Ftrl(), False
        for batch in batches:
            for x, y in zip(batch.column("features"), batch.column("label").to_pylist(), strict=True):
                model.learn(unpacked(x.as_py()), y)
                any_row = True
        w, bias = model.weights(slice(None)), model.bias_weight()
        at = np.flatnonzero(w)
        model.z = model.n = None
        K.give_back()
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([bias, *w[at].tolist()], pa.float64())], ["feature", "weight"])

    encoded = stash(rows.mapInArrow(encode, "id string, place long, label int, features binary"), "features")
    epoch = F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")
    streamed = encoded.select(epoch, "*").repartition(1).sortWithinPartitions("epoch", "place", "id", "features").select("label", "features")
    return [(r["feature"], r["weight"]) for r in streamed.mapInArrow(fit, "feature int, weight double").collect()]


def packed(features: np.ndarray) -> bytes:
    """Sorted feature numbers as gaps, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.diff(features, prepend=np.int32(0)).astype("<i4").reshape(-1, 1).view(np.uint8).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int32)


def hash_of(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True)


def score(docs: DataFrame, weights: list[tuple[int, float]], columns: list[str] | None = None) -> DataFrame:
    """docs' columns (doc_id and text, or those named) with score, a double from 0 to 1."""
    small_batches(docs.sparkSession)
    dense = np.zeros(1 << BITS, dtype=np.float32)
    bias = 0.0
    for feature, weight in weights:
        if feature < 0:
            bias = weight
        else:
            dense[feature] = weight
    held = docs.sparkSession.sparkContext.broadcast(dense)
    narrow = docs.select(columns or ["doc_id", "text"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.of_column(part.column("text"), K.NOT_ALNUM, True)
                keys = []
                for at, f in features(words):
                    live = np.flatnonzero(w[f])
                    keys.append(((np.searchsorted(words.first, at[live], "right") - 1).astype(np.int64) << BITS) | f[live])
                keys = np.unique(np.concatenate(keys))
                total = np.bincount(keys >> BITS, weights=w[keys & ((1 << BITS) - 1)], minlength=part.num_rows) + bias
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*part.schema.names, "score"])
            K.give_back()

    return narrow.mapInArrow(apply, with_fields(narrow, "score double"))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0
