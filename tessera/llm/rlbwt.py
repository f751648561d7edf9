"""Suffix-array deduplication with a run-length compressed Burrows-Wheeler index.

Removed is every byte that a `width`-byte string covers which also starts earlier (smaller
doc_id, or same text and earlier start). Three steps:

1. Anchors. In each window of `width` bytes the k-gram of smallest hash (leftmost of
   equals) is its anchor. Equal windows have equal anchors at equal offsets, so a window
   whose anchor occurs nowhere else cannot be repeated. Chunks of text exchange their
   distinct anchor hashes (see rabin_karp) and learn which of them occur elsewhere, and
   which are hot (in more than HOT chunks).
2. Index. The windows of one occurrence of a repeated anchor are contiguous; their bytes
   are a snippet. Hot anchors have shorter snippets, each of STEP windows at most, which meet
   by the bytes that all those windows hold: a second, longer k-gram that splits the anchor. Chunks send
   each distinct snippet once (its first occurrence). All snippets of an anchor meet in one
   task. There the older half of each group goes into an index and the younger half is
   streamed through it, pair by pair of ever larger blocks; what is found leaves the block,
   so an index holds first occurrences only. The index is a run-length compressed BWT: run
   heads, run starts and the suffix array sampled at both ends of each run. Matching
   statistics (length and position of the longest match of each suffix of a snippet) come
   from backward steps: a step that leaves the run goes to the next run of the wanted byte
   above or below, whose sample gives the text to compare with. A window is marked where
   the statistic is `width` or more.
3. Marks go back to the chunks as bits, in which spans are merged.

Hashes only propose which windows are first occurrences; windows whose 64-bit hash no other
snippet of the task has are neither indexed nor streamed, and snippets, or parts of them,
that are equal byte for byte (compared, not only by hash) are streamed once for all.

Edge cases: null and empty texts, and texts shorter than `width`, stay whole; a row that
repeats with its id counts as later than the one met first (by chunk and place); a null
doc_id counts as later than all others; very long texts are chunks of their own; an empty
table gives an empty result; of other columns those named in `columns` are carried along.
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
from .rabin_karp import BLOBS, Keyed, blob_rows, chunked, key_bytes, repeated_elsewhere, unpacked
from .shared import power_of_two, small_batches, stash, text_bytes, with_fields

#: A chunk takes about 100 bytes of working memory a byte.
CHUNK_BYTES = 1 << 18
RANGE_BYTES = 4 << 20
#: An index is built over about so many bytes; more are indexed in parts, one after the other.
INDEX_BYTES = 1 << 19
#: A task works on so many bytes of snippets at once, whole anchors.
WORK_BYTES = 2 << 20
LAST = np.iinfo(np.int64).max
KGRAM = 40
#: Anchors in more chunks than HOT are split by the bytes that STEP windows have in common.
HOT, STEP = 512, 8


def anchor_runs(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """For each run of windows with one anchor: the number of windows, and where the anchor is in the first (two rows)."""
    n, k = len(data), min(KGRAM, width)
    fits = window_starts(offsets, width)
    if not len(fits):
        return np.zeros((2, 0), np.uint16)
    grams = K.RangeHash(K.byte_table(40, False)[data], 0x5851F42D4C957F2D).all(k)
    low = K.U64(int(n).bit_length())
    best = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    span, w = 1, width - k + 1
    while span * 2 <= w:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < w:
        best = np.minimum(best[: len(best) - (w - span)], best[w - span :])
    anchor = (best[fits] & K.U64((1 << int(low)) - 1)).astype(np.int64)
    new = np.ones(len(fits), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1] + 1)
    first = np.flatnonzero(new)
    return np.stack([np.diff(np.append(first, len(fits))), anchor[first] - fits[first]]).astype(np.uint16)


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Where windows start, in order."""
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    return K.spread(offsets[:-1], n)


class Anchored:
    """The anchor occurrences of a chunk: for each the first window, the number of windows, the anchor's place and its hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, runs: np.ndarray, width: int, ranges: int, size: int):
        self.data, self.offsets, self.width, self.ranges = data, offsets, width, ranges
        self.n, ahead = runs.astype(np.int64)
        fits = window_starts(offsets, width)
        self.start = fits[np.cumsum(self.n) - self.n]
        self.anchor = self.start + ahead
        # Mixed anew: hashes of anchors are the smallest of many, and would all lie in the first ranges.
        self.key = K.mixed(K.RangeHash(K.byte_table(40, False)[data], 0x5851F42D4C957F2D).of(self.anchor, self.anchor + min(KGRAM, width)))
        self.keyed = Keyed([self.key], (size,), ranges)

    def snippets(self, masks: list[dict] | None, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Snippets with repeated anchors, by key and age: start, n, key, row, and again, which of them repeat an older one of the chunk."""
        hot = np.zeros(len(self.keyed.n), dtype=bool)
        for m in masks or ():
            if m["hot"]:
                a, b = self.keyed.cuts[m["range"]], self.keyed.cuts[m["range"] + 1]
                hot[a:b] = unpacked_bits(m["hot"], b - a)
        own = np.flatnonzero(self.keyed.repeated(masks))
        start, n, key = self.start[own], self.n[own], self.key[own]
        split = hot[self.keyed.place[own]]
        if split.any():
            parts = self.split(start[split], n[split], self.anchor[own][split])
            start, n, key = (np.concatenate([x[~split], y]) for x, y in zip((start, n, key), parts, strict=True))
        row = np.searchsorted(self.offsets, start, "right") - 1
        order = np.lexsort((start, row, ids[row], key))
        start, n, key, row = start[order], n[order], key[order], row[order]
        length = n + self.width - 1
        first = first_of_equals(self.data, start, length, key, np.arange(len(start)))
        return {"start": start, "n": n, "key": key, "row": row, "length": length, "again": first != np.arange(len(start)), "cuts": range_cuts(key, self.ranges)}

    def split(self, start: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Snippets of hot anchors, cut where the anchor's place in the window passes a multiple of STEP; their key is a hash of what all such windows hold."""
        at = K.spread(start, n)
        turn = (np.repeat(anchor, n) - at) // STEP
        new = np.ones(len(at), dtype=bool)
        new[1:] = (turn[1:] != turn[:-1]) | (at[1:] != at[:-1] + 1)
        # A run of one snippet may go on in the next; their anchors differ.
        new[np.cumsum(n)[:-1]] = True
        first = np.flatnonzero(new)
        begin = np.repeat(anchor, n)[first] - turn[first] * STEP
        key = K.RangeHash(K.byte_table(43, False)[self.data], 0x2545F4914F6CDD1D).of(begin, begin + max(self.width - STEP + 1, 1))
        return at[first], np.diff(np.append(first, len(at))), K.mixed(key ^ K.mixed(turn[first].astype(np.uint64) + K.U64(1)))


def unpacked_bits(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` (a power of two over 1) equal parts of the hash values begins in sorted keys."""
    shift = K.U64(64 - int(ranges).bit_length() + 1)
    return np.searchsorted(keys >> shift, np.arange(ranges + 1, dtype=np.uint64))


def range_hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, a block at a time."""
    out = np.empty(len(begin), dtype=np.uint64)
    for p in K.blocks(length):
        ends = np.cumsum(length[p])
        out[p] = K.RangeHash(K.byte_table(41, False)[data[K.spread(begin[p], length[p])]], 0x2545F4914F6CDD1D).of(ends - length[p], ends)
    return out


def first_of_equals(data: np.ndarray, begin: np.ndarray, length: np.ndarray, key: np.ndarray, age: np.ndarray) -> np.ndarray:
    """For each byte range the number of the oldest equal one with its key: itself, if there is none. Hashes propose, bytes decide."""
    out = np.arange(len(begin))
    h = K.mixed(range_hashes(data, begin, length) ^ K.mixed(length.astype(np.uint64)) ^ key)
    order = np.lexsort((age, h))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = h[order[1:]] == h[order[:-1]]
    head = np.flatnonzero(~same)
    first = order[np.repeat(head, np.diff(np.append(head, len(order))))]
    x, y = order[same], first[same]
    fine = (length[x] == length[y]) & (key[x] == key[y])
    x, y = x[fine], y[fine]
    equal = K.equal_ranges(data, begin[x], data, begin[y], length[x])
    out[x[equal]] = y[equal]
    return out


def window_hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of byte ranges, computed a block at a time."""
    out, at = np.empty(int((length - width + 1).sum()), dtype=np.uint64), 0
    for p in K.blocks(length):
        start = K.spread(np.cumsum(length[p]) - length[p], length[p] - width + 1)
        part = data[K.spread(begin[p], length[p])]
        out[at : at + len(start)] = K.RangeHash(K.byte_table(41, False)[part], 0x2545F4914F6CDD1D).of(start, start + width)
        at += len(start)
    return out


def has_equal(a: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(a)
    in_order = a[order]
    same = in_order[1:] == in_order[:-1]
    out = np.zeros(len(a), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


#: So many codes of nine bits make the first sort key.
FIRST_SPAN = 7


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """The suffix array of codes (below 512, the last one smallest and alone), by prefix doubling."""
    n = len(codes)
    padded = np.zeros(n + FIRST_SPAN, dtype=np.uint64)
    padded[:n] = codes
    key = np.zeros(n, dtype=np.uint64)
    for i in range(FIRST_SPAN):
        key = (key << K.U64(9)) | padded[i : n + i]
    span = FIRST_SPAN
    while True:
        order = np.argsort(key)
        in_order = key[order]
        number = np.zeros(n, dtype=np.uint64)
        np.cumsum(in_order[1:] != in_order[:-1], out=number[1:])
        if number[-1] == n - 1:
            return order.astype(np.int32)
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = number
        key = rank << K.U64(32)
        key[:-span] |= rank[span:] + K.U64(1)
        span *= 2


class RunIndex:
    """A run-length compressed BWT of texts, with the suffix array sampled at both ends of each run.

    Each text is followed by a terminator of code 1; byte b has code b + 2, and a 0 ends
    the whole. The suffix array itself is not kept.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        n = int(lengths.sum() + len(lengths)) + 1
        begin = np.cumsum(lengths + 1) - lengths - 1
        self.codes = np.ones(n, dtype=np.uint16)
        self.codes[-1] = 0
        self.codes[K.spread(begin, lengths)] = data.astype(np.uint16) + 2
        order = suffix_order(self.codes)
        bwt = self.codes[order - 1]
        edge = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        ends = np.append(edge[1:], n)
        self.run_start, self.run_end, self.head = edge, ends - 1, bwt[edge]
        self.start_sample, self.end_sample = order[edge].astype(np.int64), order[ends - 1].astype(np.int64)
        sizes = ends - edge
        #: Runs by head and place: `place` of the runs of code c are c * (number of runs) + run, in order.
        self.by_head = np.argsort(self.head, kind="stable")
        self.place = self.head[self.by_head].astype(np.int64) * len(edge) + self.by_head
        #: For each run: the row that LF gives its first row. Rows of the first column are in order of codes, and of one code in order of its runs.
        self.target = np.empty(len(edge), dtype=np.int64)
        self.target[self.by_head] = np.cumsum(sizes[self.by_head]) - sizes[self.by_head]

    def statistics(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of patterns (ranges of data), longest first, from their ends: at each step the patterns
        (numbers) that still go on, their places, and length and position of the longest match that starts there."""
        by_length = np.argsort(-length, kind="stable")
        sorted_length = length[by_length]
        m = len(by_length)
        row, pos, size = (np.zeros(m, dtype=np.int64) for _ in range(3))
        runs = len(self.head)
        for step in range(1, int(sorted_length[0]) + 1 if m else 0):
            live = int(np.searchsorted(-sorted_length, -step, "right"))
            if live < m:
                row, pos, size, m = row[:live], pos[:live], size[:live], live
            at = sorted_length[:live] - step
            here = begin[by_length[:live]] + at
            code = data[here].astype(np.int64) + 2
            run = np.searchsorted(self.run_start, row, "right") - 1
            off = np.flatnonzero(self.head[run] != code)
            if len(off):
                wanted = code[off] * runs
                next_one = np.searchsorted(self.place, wanted + run[off])
                below = self.place[np.minimum(next_one, runs - 1)] - wanted
                above = self.place[np.maximum(next_one - 1, 0)] - wanted
                has_below = (next_one < runs) & (below >= 0) & (below < runs)
                has_above = (next_one > 0) & (above >= 0) & (above < runs)
                below, above = np.where(has_below, below, 0), np.where(has_above, above, 0)
                one = self.common(data, here[off] + 1, self.start_sample[below], np.where(has_below, size[off], 0))
                two = self.common(data, here[off] + 1, self.end_sample[above], np.where(has_above, size[off], 0))
                down = has_below & ((one > two) | ~has_above)
                run[off] = np.where(down, below, above)
                row[off] = np.where(down, self.run_start[below], self.run_end[above])
                pos[off] = np.where(down, self.start_sample[below], self.end_sample[above])
                size[off] = np.where(has_below | has_above, np.where(down, one, two), -1)
            row = self.target[run] + row - self.run_start[run]
            pos, size = pos - 1, size + 1
            none = size <= 0  # a byte that no text holds: begin anew at any row
            row[none] = 0
            yield by_length[:live], at, size, pos

    def common(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes data from a and the texts from b have in common, up to `most`."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(most > 0)
        ahead = np.arange(16)
        while len(live):
            x = data[np.minimum(a[live, None] + out[live, None] + ahead, len(data) - 1)].astype(np.uint16) + 2
            y = self.codes[np.minimum(b[live, None] + out[live, None] + ahead, len(self.codes) - 1)]
            differ = x != y
            n = np.where(differ.any(1), differ.argmax(1), 16)
            out[live] += n
            live = live[(n == 16) & (out[live] < most[live])]
        return np.minimum(out, most)


def runs_of(flags: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of set flags within parts (the part of each flag): where they begin and end."""
    same = part[1:] == part[:-1]
    head, tail = flags.copy(), flags.copy()
    head[1:] &= ~(flags[:-1] & same)
    tail[:-1] &= ~(flags[1:] & same)
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def marks_of(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, group: np.ndarray, age: np.ndarray, width: int) -> np.ndarray:
    """For parts of snippets (first byte, number of windows; in order of group): a flag for each window, set if an older part of its group holds it too.

    Of windows with one hash the oldest is indexed and the others are streamed. What isn't
    found, though an older window has its hash, differs from that one: it goes into a next round.
    """
    first = np.cumsum(windows) - windows
    marks = np.zeros(int(windows.sum()), dtype=bool)
    part = np.repeat(np.arange(len(windows)), windows)
    hashes = window_hashes(data, begin, windows + width - 1, width)
    open_ = np.arange(len(marks))
    while len(open_):
        by_hash = open_[np.lexsort((age[part[open_]], hashes[open_]))]
        same = hashes[by_hash[1:]] == hashes[by_hash[:-1]]
        again, followed = np.append(False, same), np.append(same, False)
        texts = runs_of(flagged(len(marks), by_hash[~again & followed]), part)
        asked = runs_of(flagged(len(marks), by_hash[again]), part)
        (text_part, text_begin, text_windows), (ask_part, ask_begin, ask_windows) = ((part[a], begin[part[a]] + a - first[part[a]], b - a) for a, b in (texts, asked))
        for p in K.blocks(text_windows + width, INDEX_BYTES):
            length = text_windows[p] + width - 1
            index = RunIndex(data[K.spread(text_begin[p], length)], length)
            text_age, ends = age[text_part[p]], np.cumsum(length + 1)
            groups = group[ask_part]
            lo, hi = np.searchsorted(groups, group[text_part[p.start]], "left"), np.searchsorted(groups, group[text_part[p.stop - 1]], "right")
            for q in K.blocks(ask_windows[lo:hi] + width, INDEX_BYTES):
                mine = slice(lo + q.start, lo + q.stop)
                own_age, at = age[ask_part[mine]], asked[0][mine]
                for which, place, n, pos in index.statistics(data, ask_begin[mine], ask_windows[mine] + width - 1):
                    hit = np.flatnonzero(n >= width)
                    hit = hit[text_age[np.searchsorted(ends, pos[hit], "right")] < own_age[which[hit]]]
                    marks[at[which[hit]] + place[hit]] = True
        open_ = by_hash[again & ~marks[by_hash]]
    return marks


def flagged(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[at] = True
    return out


def indexed(table: pa.Table, width: int) -> pa.Table:
    """chunk, range, bits: marks of all windows of the snippets that each chunk sent for this range."""
    unzip = zstandard.ZstdDecompressor()
    blobs = [unzip.decompress(b.as_py()) for b in table.column("blob")]
    chunks = table.column("chunk").to_pylist()
    heads, texts, source = [], [], []
    for i, b in enumerate(blobs):
        m = int.from_bytes(b[:8], "little")
        heads.append(np.frombuffer(b, np.int64, 4 * m, 8).reshape(4, m))
        texts.append(np.frombuffer(b, np.uint8, offset=8 + 32 * m))
        source.append(np.full(m, i, np.int32))
    head, data, source = np.concatenate(heads, 1), np.concatenate(texts), np.concatenate(source)
    counts = [len(x[0]) for x in heads]
    del blobs, heads, texts
    key, doc, start, lengths = head[0].view(np.uint64), head[1], head[2], head[3]
    begin = np.cumsum(lengths) - lengths
    order = np.lexsort((start, np.array(chunks)[source], doc))
    age = np.empty(len(order), dtype=np.int64)
    age[order] = np.arange(len(order))
    count = lengths - width + 1
    first = np.concatenate([[0], np.cumsum(count)])
    marks = np.zeros(int(first[-1]), dtype=bool)
    by_key = np.lexsort((age, key))
    edge = np.flatnonzero(np.concatenate([[True], key[by_key[1:]] != key[by_key[:-1]]]))
    sizes = np.add.reduceat(lengths[by_key], edge)
    edge = np.append(edge, len(by_key))
    for p in K.blocks(sizes, WORK_BYTES):
        own = by_key[edge[p.start] : edge[p.stop]]
        mark_anchors(data, begin[own], lengths[own], key[own], age[own], first[:-1][own], width, marks)
    edges = np.concatenate([[0], np.cumsum(counts)])
    bits = [np.packbits(marks[first[a] : first[b]]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "range": pa.array([table.column("range")[0].as_py()] * len(bits), pa.int32()), "bits": pa.array(bits, pa.binary())})


def mark_anchors(data: np.ndarray, begin: np.ndarray, length: np.ndarray, key: np.ndarray, age: np.ndarray, mark: np.ndarray, width: int, marks: np.ndarray) -> None:
    """Sets marks (each snippet's begin at `mark`) for all windows of whole groups of snippets that an older one holds."""
    count = length - width + 1
    older = first_of_equals(data, begin, length, key, age)
    again = older != np.arange(len(older))
    marks[K.spread(mark[again], count[again])] = True
    # Only windows whose hash another snippet has too can be found in an index.
    own = np.flatnonzero(~again)
    shared = has_equal(window_hashes(data, begin[own], length[own], width))
    snippet = np.repeat(own, count[own])
    window = K.spread(np.zeros(len(own), np.int64), count[own])
    a, b = runs_of(shared, snippet)
    snippet, offset, windows = snippet[a], window[a], b - a
    begin, mark, key, age = begin[snippet] + offset, mark[snippet] + offset, key[snippet], age[snippet]
    older = first_of_equals(data, begin, windows + width - 1, key, age)
    again = older != np.arange(len(older))
    marks[K.spread(mark[again], windows[again])] = True
    own = np.flatnonzero(~again)
    marks[K.spread(mark[own], windows[own])] = marks_of(data, begin[own], windows[own], key[own], age[own], width)


def find_repeats(docs: DataFrame, width: int = 100, columns: list[str] | None = None) -> DataFrame:
    """docs' columns (doc_id and text, or those named) with spans, maximal runs [start, end) of bytes to remove.

    docs: doc_id (integer), text. width: from FIRST_SPAN to 65,535.
    """
    assert FIRST_SPAN <= width < 1 << 16
    small_batches(docs.sparkSession)
    total = text_bytes(docs, "text")
    ranges = power_of_two(total / RANGE_BYTES, 256, 1 << 20)
    size = key_bytes(total)
    docs = docs.select(columns or ["doc_id", "text"])

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1)
        for batch in batches:
            runs = [pack.compress(anchor_runs(*K.text_buffer(unpacked(p.as_py()).column("text")), width).tobytes()) for p in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.binary())], [*batch.schema.names, "runs"])
            K.give_back()

    chunks = stash(chunked(docs, CHUNK_BYTES).mapInArrow(find_anchors, "chunk long, payload binary, runs binary"), "chunks")

    def loaded(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table, Anchored, np.ndarray]]:
        unzip = zstandard.ZstdDecompressor()
        for i in range(batch.num_rows):
            rows = unpacked(batch.column("payload")[i].as_py())
            runs = np.frombuffer(unzip.decompress(batch.column("runs")[i].as_py()), np.uint16).reshape(2, -1)
            ids = rows.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
            yield i, rows, Anchored(*K.text_buffer(rows.column("text")), runs, width, ranges, size), ids
        K.give_back()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, _, anchored, _ in loaded(batch):
                yield blob_rows(batch.column("chunk")[k].as_py(), anchored.keyed.blobs())

    def send_snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1)
        for batch in batches:
            for k, _, anchored, ids in loaded(batch):
                found = anchored.snippets(batch.column("masks")[k].as_py(), ids)
                out = []
                for i in np.flatnonzero(np.diff(found["cuts"])).tolist():
                    part = np.arange(found["cuts"][i], found["cuts"][i + 1])
                    part = part[~found["again"][part]]
                    start, row, length = found["start"][part], found["row"][part], found["length"][part]
                    # Age within a chunk: by id, row, and start; rows are put before starts.
                    head = np.stack([found["key"][part].view(np.int64), ids[row], (row << 40) + start - anchored.offsets[row], length])
                    out.append((i, pack.compress(len(part).to_bytes(8, "little") + head.astype("<i8").tobytes() + anchored.data[K.spread(start, length)].tobytes())))
                yield blob_rows(batch.column("chunk")[k].as_py(), out)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows, anchored, ids in loaded(batch):
                found = anchored.snippets(batch.column("masks")[k].as_py(), ids)
                # A snippet that the chunk has in an older place goes whole; of the others the bits tell, range by range.
                sent = np.flatnonzero(~found["again"])
                cuts = range_cuts(found["key"][sent], ranges)
                flags = []
                for m in sorted(batch.column("marks")[k].as_py() or (), key=lambda m: m["range"]):
                    flags.append(unpacked_bits(m["bits"], int(found["n"][sent[cuts[m["range"]] : cuts[m["range"] + 1]]].sum())))
                windows = K.spread(found["start"][sent], found["n"][sent])
                gone = [windows[np.concatenate(flags)] if flags else windows[:0], K.spread(found["start"][found["again"]], found["n"][found["again"]])]
                spans = K.runs(K.covered(len(anchored.data), np.concatenate(gone), width), anchored.offsets)
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in rows.columns), pa.array(spans, pa.list_(pa.list_(pa.int64())))], [*rows.schema.names, "spans"])

    def mark_range(t: pa.Table) -> pa.Table:
        out = indexed(t, width)
        K.give_back()
        return out

    masks = stash(repeated_elsewhere(chunks.mapInArrow(send, BLOBS), (size,), HOT), "anchors")
    masked = chunks.join(masks, "chunk", "left")
    snippets = masked.mapInArrow(send_snippets, BLOBS)
    marks = snippets.groupBy("range").applyInArrow(mark_range, "chunk long, range int, bits binary").groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias("marks"))
    return masked.join(stash(marks, "marks"), "chunk", "left").mapInArrow(mark, with_fields(docs, "spans array<array<bigint>>"))


def kept_bytes(text: str | None, spans: list[list[int]]) -> bytes:
    data, at, out = (text or "").encode(), 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def kept_digest(text: str | None, spans: list[list[int]]) -> str:
    return hashlib.sha256(kept_bytes(text, spans)).hexdigest()
