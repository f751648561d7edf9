"""Substring deduplication: Rabin-Karp hashes of every token window, counted in Spark.

Texts are dealt into chunks of about a megabyte, which are written once to the shared
folder. Every window of every chunk is hashed with a rolling polynomial; each chunk sends
each of its distinct hashes once (a hot passage therefore costs one entry a chunk, however
often it occurs), packed by hash range into sorted blobs. A task counts one range and sends
back to each chunk a bit per hash: whether another chunk has it. The chunks then mark the
words that repeated windows cover and merge them into maximal removal intervals.

Hashes are counted twice. The first count is over as many leading bytes of a 64-bit hash as
make chance collisions rare for the size of the corpus (key_bytes); it only proposes. The
second is over 128 bits, of the proposed windows alone, and decides: for 10**13 windows the
chance of one false pair anywhere is 10**-13 or so.

Edge cases: null and empty texts have no words and nothing is removed; texts shorter than
a window stay whole; a row that repeats, id included, counts as another occurrence; ids
may be null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import power_of_two, small_batches, stash, text_bytes

CHUNK_BYTES = 1 << 20
RANGE_BYTES = 8 << 20


def chunked(docs: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """chunk, payload: rows of docs with about `most` bytes of text, as a compressed Arrow stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in K.slices(batch, "text", most):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
                    out.write_batch(rows)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "payload"])
                at += 1

    return docs.mapInArrow(pack, "chunk long, payload binary")


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def key_bytes(n: int) -> int:
    """So many leading bytes of a hash that few of n different values share them with another one."""
    return min(8, -(-(max(n, 1).bit_length() + 7) // 8))


def repeated_elsewhere(sent: DataFrame, sizes: tuple[int, ...], hot: int | None = None) -> DataFrame:
    """chunk, masks: for each range of a chunk's keys, bits that say which of them other chunks sent too, and (hot, else null) which more than `hot` chunks sent.

    sent: range, chunk, blob (sorted distinct keys; a key has a part of each of `sizes` bytes, and the planes of the parts are one after the other).
    """

    def count(table: pa.Table) -> pa.Table:
        chunks, blobs = table.column("chunk").to_pylist(), table.column("blob").to_pylist()
        n = [len(b) // sum(sizes) for b in blobs]
        parts, at = [], 0
        for size in sizes:
            parts.append(np.concatenate([K.from_planes(b[at * k : (at + size) * k], size) for b, k in zip(blobs, n, strict=True)]))
            at += size
        del blobs
        order = np.lexsort(parts[::-1]) if len(parts) > 1 else np.argsort(parts[0], kind="stable")
        same = np.ones(len(order) - 1, dtype=bool)
        for part in parts:
            same &= part[order[1:]] == part[order[:-1]]
        twice = np.zeros(len(order), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        often = np.zeros(len(order) if hot else 0, dtype=bool)
        if hot:
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(head, len(order)))
            often[order] = np.repeat(size > hot, size)
        ends = np.cumsum(n).tolist()
        found = [(c, np.packbits(twice[e - k : e]).tobytes(), np.packbits(often[e - k : e]).tobytes() if often[e - k : e].any() else None) for c, k, e in zip(chunks, n, ends, strict=True) if twice[e - k : e].any()]
        at = table.column("range")[0].as_py()
        out = pa.table({"chunk": pa.array([c for c, _, _ in found], pa.int64()), "range": pa.array([at] * len(found), pa.int32()), "bits": pa.array([m for _, m, _ in found], pa.binary()), "hot": pa.array([h for _, _, h in found], pa.binary())})
        K.give_back()
        return out

    return sent.groupBy("range").applyInArrow(count, "chunk long, range int, bits binary, hot binary").groupBy("chunk").agg(F.collect_list(F.struct("range", "bits", "hot")).alias("masks"))


def blob_rows(chunk: int, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in blobs], pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array([b for _, b in blobs], pa.binary())], ["range", "chunk", "blob"])


BLOBS = "range int, chunk long, blob binary"


class Keyed:
    """Windows by sorted distinct keys: `parts` hold the keys, `place` is each window's key, `n` says how many windows have it."""

    def __init__(self, hashes: list[np.ndarray], sizes: tuple[int, ...], ranges: int):
        self.sizes = sizes
        short = [h >> K.U64(64 - 8 * size) if size < 8 else h for h, size in zip(hashes, sizes, strict=True)]
        order = np.lexsort(short[::-1]) if len(short) > 1 else np.argsort(short[0])
        new = np.ones(len(order), dtype=bool)
        if len(order):
            new[1:] = np.logical_or.reduce([h[order[1:]] != h[order[:-1]] for h in short])
        self.parts = [h[order[new]] for h in short]
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.n = np.bincount(self.place, minlength=len(self.parts[0]))
        shift = 8 * sizes[0] - int(ranges).bit_length() + 1
        self.cuts = np.searchsorted(self.parts[0] >> K.U64(shift), np.arange(ranges + 1, dtype=np.uint64))

    def blobs(self) -> list[tuple[int, bytes]]:
        return [(i, b"".join(K.planes(p[self.cuts[i] : self.cuts[i + 1]], size) for p, size in zip(self.parts, self.sizes, strict=True))) for i in np.flatnonzero(np.diff(self.cuts)).tolist()]

    def repeated(self, masks: list[dict] | None) -> np.ndarray:
        """Which windows have a key that occurs more than once anywhere."""
        twice = self.n > 1
        for m in masks or ():
            a, b = self.cuts[m["range"]], self.cuts[m["range"] + 1]
            twice[a:b] |= np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=b - a).astype(bool)
        return twice[self.place]


def repeated_windows(docs: DataFrame, width: int = 35) -> DataFrame:
    """doc_id, text, n_words, spans: maximal runs [start, end) of words in windows that start anywhere else too.

    docs: doc_id, text; words are runs of bytes that aren't ASCII white space, unchanged.
    """
    small_batches(docs.sparkSession)
    total = text_bytes(docs, "text")
    ranges = power_of_two(total / RANGE_BYTES, 256, 1 << 20)
    one, two = (key_bytes(total),), (8, 8)
    chunks = stash(chunked(docs.select("doc_id", "text")), "chunks")

    def windows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table, K.Words, np.ndarray, Keyed]]:
        for i in range(batch.num_rows):
            rows = unpacked(batch.column("payload")[i].as_py())
            words = K.of_column(rows.column("text"), K.SPACE, False)
            at, first = words.windows(width)
            yield i, rows, words, at, Keyed([first], one, ranges)
        K.give_back()

    def proposed(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table, K.Words, np.ndarray, Keyed]]:
        """The windows that the first count proposes, by both hashes."""
        for i, rows, words, at, keyed in windows_of(batch):
            at = at[keyed.repeated(batch.column("masks")[i].as_py())]
            hashes = [K.RangeHash(words.hash, base).of(at, at + width) for base in (K.WINDOW_BASE, 0x369DEA0F31A53F85)]
            yield i, rows, words, at, Keyed(hashes, two, ranges)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, _, _, keyed in windows_of(batch):
                yield blob_rows(batch.column("chunk")[i].as_py(), keyed.blobs())

    def send_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, _, _, keyed in proposed(batch):
                yield blob_rows(batch.column("chunk")[i].as_py(), keyed.blobs())

    kind = docs.schema["doc_id"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, rows, words, at, keyed in proposed(batch):
                gone = K.covered(len(words), at[keyed.repeated(batch.column("sure")[i].as_py())], width)
                spans = K.runs(gone, words.first)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), rows.column("text").combine_chunks(), pa.array(words.counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["doc_id", "text", "n_words", "spans"])

    masks = stash(repeated_elsewhere(chunks.mapInArrow(send, BLOBS), one), "proposed")
    masked = chunks.join(masks, "chunk", "left")
    sure = stash(repeated_elsewhere(masked.mapInArrow(send_both, BLOBS), two), "repeated").withColumnRenamed("masks", "sure")
    return masked.join(sure, "chunk", "left").select("payload", "masks", "sure").mapInArrow(mark, f"doc_id {kind}, text string, n_words long, spans array<array<bigint>>")


def kept_words(text: str | None, spans: list[list[int]]) -> list[bytes]:
    words = (text or "").encode().split()
    for a, b in reversed(spans):
        del words[a:b]
    return words


def kept_digest(text: str | None, spans: list[list[int]]) -> str:
    return hashlib.sha256(b" ".join(kept_words(text, spans))).hexdigest()
