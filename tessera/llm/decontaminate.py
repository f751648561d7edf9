"""Benchmark decontamination with a broadcast hash set of normalised benchmark n-grams.

Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII bytes. A window
is `width` consecutive words of a benchmark item, or the whole item if it has fewer but
some. Training texts are scanned window by window: a table of hashes proposes hits, the
words themselves confirm them.

The hash set is broadcast while the benchmark has at most BROADCAST_BYTES of text (a
checked bound; a word takes 24 bytes in the set, so it has 12 times that at most). A larger
benchmark is cut into parts of that size which are scanned one after the other, and the
hits are merged.

Edge cases: null and empty texts have no words and no hits; doc_ids may be null and rows
may repeat; item_ids that repeat (with whatever texts) are reported once; items without an
id mark words, but are not among the items reported; an empty benchmark marks nothing;
columns other than the named ones are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import small_batches, with_fields

BROADCAST_BYTES = 8 << 20
SLOTS = 1 << 22


class Windows:
    """All distinct windows of a benchmark, by length, with the items they are from."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        words = K.of_column(pa.array([t or "" for _, t in items], pa.string()), K.NOT_ALNUM, True)
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        self.data, self.start, self.end = K.LOWER[words.data], words.start.astype(np.int32), words.end.astype(np.int32)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        counts = words.counts
        owner = np.repeat(np.arange(len(items)), counts)
        #: The id of each item; -1 where it has none.
        named = np.array([-1 if i is None else number[str(i)] for i, _ in items], dtype=np.int32)
        for n in sorted({width, *counts[(counts > 0) & (counts < width)].tolist()}):
            at, h = words.windows(n)
            own = owner[at]
            if n < width:
                fits = counts[own] == n
                at, h, own = at[fits], h[fits], own[fits]
            if len(at):
                order = np.argsort(h, kind="stable")
                slots = np.zeros(SLOTS, dtype=bool)
                slots[(h & K.U64(SLOTS - 1)).astype(np.int64)] = True
                self.by_width[n] = (h[order], at[order].astype(np.int32), named[own[order]], slots)

    def hits(self, words: K.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words in `words` and items of the confirmed hits of this width."""
        known, where, own, slots = self.by_width[width]
        at, h = words.windows(width)
        maybe = slots[(h & K.U64(SLOTS - 1)).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        starts = np.repeat(at, n)
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
        same = self.equal(words, starts, where[which], width)
        return starts[same], own[which[same]]

    def equal(self, words: K.Words, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        """Whether windows a of words and b of the benchmark have the same words, byte for byte."""
        ok = np.ones(len(a), dtype=bool)
        lower = K.LOWER[words.data] if len(a) else words.data
        for i in range(width):
            live = np.flatnonzero(ok)
            x, y = words.start[a[live] + i], self.start[b[live] + i].astype(np.int64)
            n = words.end[a[live] + i] - x
            same = n == self.end[b[live] + i] - y
            ok[live[~same]] = False
            ok[live[same]] = K.equal_ranges(lower, x[same], self.data, y[same], n[same])
        return ok


def scanner(windows: Windows, columns: list[str], suffix: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.of_column(part.column("text"), K.NOT_ALNUM, True)
                hit = np.zeros(len(words), dtype=bool)
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for n in windows.by_width:
                    at, own = windows.hits(words, n)
                    hit |= K.covered(len(words), at, n)
                    found.append((np.searchsorted(words.first, at, "right") - 1, own))
                doc, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
                items: list[list[str]] = [[] for _ in range(part.num_rows)]
                for d, i in set(zip(doc.tolist(), own.tolist(), strict=True)):
                    if i >= 0:
                        items[d].append(windows.names[i])
                spans = K.runs(hit, words.first)
                bytes_of = [_in_bytes(words, k, x) for k, x in enumerate(spans)]
                spans_kind = pa.list_(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(words.counts, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, spans_kind), pa.array(bytes_of, spans_kind)],
                    [*columns, "n_words", *(f"{c}{suffix}" for c in ("items", "hits", "spans"))],
                )
            K.give_back()

    return scan


def _in_bytes(words: K.Words, row: int, spans: list[list[int]]) -> list[list[int]]:
    base, first = words.offsets[row], words.first[row]
    return [[int(words.start[first + a] - base), int(words.end[first + b - 1] - base)] for a, b in spans]


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, columns: list[str] | None = None) -> DataFrame:
    """docs' columns (doc_id and text, or those named) with n_words, n_hit, items (sorted ids as strings), spans (hit runs as [start, end) bytes).

    docs: doc_id, text. benchmark: item_id, text.
    """
    small_batches(docs.sparkSession)
    columns = columns or ["doc_id", "text"]
    passages = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = passages.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("b")).first()["b"] or 0
    parts = -(-2 * size // BROADCAST_BYTES) if size > BROADCAST_BYTES else 1
    found, one = docs.select(columns), F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        found = _scan(found, passages.where(one == i) if parts > 1 else passages, width, [c for c in found.columns if c != "n_words"], f"_{i}")
    merged = {c: _merged_spans(F.array_sort(F.concat(*(f"{c}_{i}" for i in range(parts))))) if parts > 1 else F.col(f"{c}_0") for c in ("hits", "spans")}
    merged["items"] = F.array_sort(F.array_distinct(F.concat(*(f"items_{i}" for i in range(parts)))))
    found = found.withColumns(merged)
    return found.select(*columns, "n_words", F.expr("aggregate(hits, 0L, (n, s) -> n + s[1] - s[0])").alias("n_hit"), "items", "spans")


def _scan(docs: DataFrame, benchmark: DataFrame, width: int, columns: list[str], suffix: str) -> DataFrame:
    # At most BROADCAST_BYTES of text, as find_leaks has checked or cut it.
    windows = Windows([(r["item_id"], r["text"]) for r in benchmark.collect()], width)
    held = docs.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scanner(held.value, columns, suffix)(batches)

    fields = with_fields(docs.select(columns), f"n_words long, items{suffix} array<string>, hits{suffix} array<array<bigint>>, spans{suffix} array<array<bigint>>")
    return docs.select(columns).mapInArrow(scan, fields)


def _merged_spans(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    none = F.expr("cast(array() as array<array<bigint>>)")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))[1] >= s[0]), longer).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, none, add)


def without_leaks(found: DataFrame, most: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """Rows of find_leaks with hit spans cut out of the text (n_chars, if carried, is counted anew); a row whose share of hit words is `most` or more goes."""
    columns = columns or ["doc_id", "text"]
    pieces = F.expr(
        "transform(sequence(0, size(spans)), i -> decode(substring(encode(text, 'UTF-8'),"
        " cast(if(i = 0, 0, spans[i - 1][1]) + 1 as int),"
        " cast(if(i = size(spans), octet_length(text), spans[i][0]) - if(i = 0, 0, spans[i - 1][1]) as int)), 'UTF-8'))"
    )
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < most * F.col("n_words")))
    kept = kept.withColumn("text", F.when(F.col("n_hit") == 0, F.col("text")).otherwise(F.array_join(pieces, "")))
    return (kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in columns else kept).select(columns)
