"""SentencePiece encoding and decoding: batched numpy Viterbi.

The model file is read here (its protocol buffer fields, no library). Texts are cut into
units that no piece crosses; the distinct units of a batch are grouped by length, and all
units of a length advance together. Hashes of all their substrings probe the sorted piece
keys, which gives a lattice of pieces for every unit. Viterbi goes over the lattice from
left to right; the maximum over piece lengths is vectorised and its argument is the
backpointer.

* Unigram models: a path's score is the sum of its pieces' scores.
* BPE models: a step scores 1 if the piece can follow the last piece of the best path to
  where it begins, else nothing. Two pieces can follow each other if merging the characters
  of both gives these two again; that depends on the two alone, and it holds for all
  neighbours of a path if and only if the path is what merging gives. So of the pieces that
  end at a place one at most has a path behind it, and the table needs one backpointer a
  place. Whether two pieces can follow each other is found by undoing merges, the later
  one first, at both sides of the border (Followers). Pieces of spaces alone may share the
  lowest score, as in the public models: then they are merged when nothing else is left,
  from the left (run_sizes).

Units that a worker has met are kept by hash, up to KNOWN of them. Units over LONG
characters take the same table one place at a time.

Characters without a piece become bytes where the model has byte pieces, else the unknown
id (once for a run of them). Models with a normalisation table or user-defined pieces are
refused, as are BPE models in which a piece's score isn't below those of its parts.

Edge cases: null and empty texts give no ids and decode to the empty text; rows that
repeat are encoded each; ids may be null; very long texts are batches of their own; an
empty table gives an empty result; other columns are not read. The character U+2581
stands for a space, as in the format, so texts that hold it don't come back unchanged.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .shared import small_batches

SPACE = 0x2581
LONG = 48
BATCH_BYTES = 1 << 19
CELLS = 1 << 19
#: Units that a worker remembers (about 30 bytes each).
KNOWN = 1 << 18
#: Slots for remembered pairs of pieces (a power of two).
ASKED = 1 << 18
SLOTS = 1 << 21
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message; embedded messages and strings stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0], at + n
        yield tag >> 3, value


class Model:
    """Pieces of a SentencePiece model and their probing tables."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        scores, kinds = [], []
        self.kind, self.prefix, self.squeeze = UNIGRAM, True, True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(fields(value))
                if spec.get(2):
                    raise ValueError("models with a normalisation table are not supported")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or USER_DEFINED in kinds:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.scores = np.array(scores)
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        self.number = {self.pieces[i]: i for i in normal}
        self.least = float(self.scores[normal].min())
        self.longest = max(len(self.pieces[i]) for i in normal)
        #: A piece with an inner word start would cross units; there is none in models that split at spaces.
        self.whole = any(0 < p.rfind("▁") and p.strip("▁") and "▁" in p.lstrip("▁") for p in self.number)
        joined = np.array(sorted({ord(c) for p in self.number if len(p) > 1 for c in p}), dtype=np.uint32)
        self.joined = np.zeros(0x110000, dtype=bool)
        self.joined[joined] = True
        self.tables = []
        for n in range(1, self.longest + 1):
            own = [i for i in normal if len(self.pieces[i]) == n]
            codes = np.array([[ord(c) for c in self.pieces[i]] for i in own], dtype=np.uint32).reshape(len(own), n)
            keys = row_hashes(codes).of_all(n)[:, 0] if own else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            slots = np.zeros(SLOTS >> 3, dtype=bool)
            slots[(keys & K.U64(len(slots) - 1)).astype(np.int64)] = True
            self.tables.append((keys[order], np.array(own, dtype=np.int32)[order], slots))
        self.followers = Followers(self) if self.kind == BPE else None
        self.known = Known()

    def probe(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """The ids of pieces of n characters with these hashes; -1 where there is none."""
        keys, ids, slots = self.tables[n - 1]
        out = np.full(hashes.shape, -1, dtype=np.int32)
        if len(keys):
            maybe = np.nonzero(slots[(hashes & K.U64(len(slots) - 1)).astype(np.int64)])
            h = hashes[maybe]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out[maybe] = np.where(keys[at] == h, ids[at], -1)
        return out

    def fallback(self, code: int) -> list[int]:
        return [self.bytes[b] for b in chr(code).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]


class row_hashes:  # noqa: N801
    """Hashes of all substrings of the rows of a matrix of code points."""

    def __init__(self, codes: np.ndarray):
        n = codes.shape[1]
        up, self.down = K.powers(0x5851F42D4C957F2D, max(n, 1))
        self.sums = np.zeros((codes.shape[0], n + 1), dtype=np.uint64)
        np.cumsum(K.mixed(codes.astype(np.uint64) + K.U64(0x1000000)) * up[:n], axis=1, out=self.sums[:, 1:])

    def of_all(self, n: int) -> np.ndarray:
        wide = self.sums.shape[1] - n
        return K.mixed((self.sums[:, n:] - self.sums[:, :wide]) * self.down[:wide])


def lattice(model: Model, codes: np.ndarray) -> np.ndarray:
    """ids[row, start, n - 1] of the pieces of n characters from each start; -1 where there is none."""
    rows, length = codes.shape
    most = min(model.longest, length)
    ids = np.full((rows, length, most), -1, dtype=np.int32)
    hashes = row_hashes(codes)
    for n in range(1, most + 1):
        ids[:, : length - n + 1, n - 1] = model.probe(hashes.of_all(n), n)
    return ids


def viterbi(model: Model, ids: np.ndarray) -> np.ndarray:
    """size[row, start] of the pieces on the best path, 0 where no piece begins."""
    rows, length, most = ids.shape
    best = np.full((rows, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((rows, length + 1), dtype=np.int64)
    floor = model.least - UNKNOWN_PENALTY
    for end in range(1, length + 1):
        sizes = np.arange(min(most, end), 0, -1)
        at = ids[:, end - sizes, sizes - 1]
        score = np.where(at >= 0, model.scores[at], np.where(sizes == 1, floor, -np.inf)) + best[:, end - sizes]
        pick = score.argmax(1)
        back[:, end] = sizes[pick]
        best[:, end] = score[np.arange(rows), pick]
    return backwards(back)


class Followers:
    """Which pieces of a BPE model can follow each other.

    Every piece that merging can make has one last merge (left, right); merges of a worse
    rank come later. Whether the pieces a and b can stand side by side is found backwards:
    of the two symbols at the border the one that was merged later is undone. If the two
    symbols that then meet make a piece whose merge would have come before the one just
    undone, merging would have taken it, and a and b don't last.
    """

    def __init__(self, model: Model):
        n = len(model.pieces)
        spaces = {i for p, i in model.number.items() if len(p) > 1 and not p.strip("▁")}
        lowest = min((model.scores[i] for p, i in model.number.items() if len(p) > 1 and i not in spaces), default=0.0)
        #: Lengths of pieces of spaces that are merged after all others; their scores are equal.
        late = {i for i in spaces if len({model.scores[i] for i in spaces}) == 1 and model.scores[i] < lowest and not model.whole}
        self.runs = {len(model.pieces[i]) for i in late}
        own = np.array(sorted(set(model.number.values()) - late))
        lengths = np.array([len(model.pieces[i]) for i in own])
        #: Characters that pieces hold but that are none themselves: symbols of their own, which only merges use.
        self.symbols = {chr(c): n + k for k, c in enumerate(c for c in np.flatnonzero(model.joined).tolist() if chr(c) not in model.number)}
        size = n + len(self.symbols)
        self.size = size
        self.rank = np.full(size, -1, dtype=np.int64)
        by_score = np.unique(-model.scores[own], return_inverse=True)[1]
        self.rank[own] = np.where(lengths > 1, by_score + 1, 0)
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.made = np.zeros(size, dtype=bool)
        self.made[own[lengths == 1]] = True
        self.made[n:] = True
        self.pairs: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.seen = np.full(ASKED, -1, dtype=np.int64), np.zeros(ASKED, dtype=bool)
        number = model.number | self.symbols
        for m in range(2, model.longest + 1):
            piece, a, b = [], [], []
            for i in own[lengths == m].tolist():
                text = model.pieces[i]
                for cut in range(1, m):
                    x, y = number.get(text[:cut]), number.get(text[cut:])
                    if x is not None and y is not None and self.made[x] and self.made[y]:
                        piece.append(i)
                        a.append(x)
                        b.append(y)
            piece, a, b = (np.array(x, dtype=np.int64) for x in (piece, a, b))
            last = self.lasts(a, b, whole=True)
            piece, a, b = piece[last], a[last], b[last]
            if len(np.unique(piece)) < len(piece) or (self.rank[piece] <= np.maximum(self.rank[a], self.rank[b])).any():
                raise ValueError("a piece of this model ranks before its parts, or has two last merges")
            self.left[piece], self.right[piece], self.made[piece] = a, b, True
            keys = np.concatenate([self.pairs[0], a * size + b])
            order = np.argsort(keys)
            self.pairs = keys[order], np.concatenate([self.pairs[1], piece])[order]

    def run_sizes(self, n: int) -> list[int]:
        """The sizes of the pieces of n spaces: the leftmost two that make a piece are merged first."""
        out: list[int] = []
        while True:
            if len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
            elif n and out and out[-1] + 1 in self.runs:
                out[-1], n = out[-1] + 1, n - 1
            elif n:
                out.append(1)
                n -= 1
            else:
                return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of two symbols; a very late one where there is none."""
        keys, made = self.pairs
        none = np.full(len(a), np.iinfo(np.int64).max)
        if not len(keys):
            return none
        key = a * self.size + b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, self.rank[made[at]], none)

    def lasts(self, a: np.ndarray, b: np.ndarray, whole: bool = False) -> np.ndarray:
        """Whether merging the characters of each a and b gives a and b again, or (whole) comes to them before it merges the two."""
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        if not whole:
            ok &= self.merge_rank(a, b) == np.iinfo(np.int64).max
            live = live[ok]
        while len(live):
            x, y = a[live], b[live]
            simple = (self.left[x] < 0) & (self.left[y] < 0)
            live, x, y = live[~simple], x[~simple], y[~simple]
            # Of equal ranks the right one is merged later.
            first = (self.left[x] >= 0) & ((self.left[y] < 0) | (self.rank[x] > self.rank[y]))
            undone = np.where(first, self.rank[x], self.rank[y])
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
            a[live], b[live] = x, y
            met = self.merge_rank(x, y)
            # A merge of the border that is left of the undone one wins ties with it, one that is right of it doesn't.
            bad = (met < undone) | ((met == undone) & ~first)
            ok[live[bad]] = False
            live = live[~bad]
        return ok

    def can(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each b can follow a; answers are remembered, one a slot."""
        keys, answers = self.seen
        key = a.astype(np.int64) * self.size + b
        slot = (K.mixed(key.view(np.uint64)) & K.U64(len(keys) - 1)).astype(np.int64)
        out = answers[slot]
        new = np.flatnonzero(keys[slot] != key)
        if len(new):
            asked, place = np.unique(key[new], return_inverse=True)
            found = self.lasts(asked // self.size, asked % self.size)[place]
            out[new] = found
            at, one = np.unique(slot[new], return_index=True)
            keys[at], answers[at] = key[new][one], found[one]
        return out


def table(model: Model, codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """viterbi for BPE models: size[row, start] of the pieces that merging leaves, 0 where none begins."""
    rows, length, most = ids.shape
    rules = model.followers
    fine = np.append(rules.made, False)  # -1, no piece, is the last
    last = np.full((rows, length + 1), -1, dtype=np.int64)
    back = np.zeros((rows, length + 1), dtype=np.int64)
    single = ids[:, :, 0].astype(np.int64)
    for r, c in zip(*np.nonzero(single < 0), strict=True):
        single[r, c] = rules.symbols.get(chr(int(codes[r, c])), -1)
    for end in range(1, length + 1):
        sizes = np.arange(1, min(most, end) + 1)
        at = ids[:, end - sizes, sizes - 1].astype(np.int64)
        at[:, 0] = single[:, end - 1]
        score = fine[at]
        before = last[:, end - sizes]
        row, k = np.nonzero(score & (sizes < end) & (before >= 0))
        score[row, k] = rules.can(before[row, k], at[row, k])
        # A character without any symbol follows all, and all follow it.
        score[:, 0] |= at[:, 0] < 0
        pick = score.argmax(1)
        back[:, end] = sizes[pick]
        last[:, end] = at[np.arange(rows), pick]
    size = backwards(back)
    if rules.runs:
        lead = np.logical_and.accumulate((codes == SPACE) & (size == 1), axis=1).sum(1)
        for n in np.unique(lead[lead > 1]).tolist():
            parts = rules.run_sizes(n)
            own = np.zeros(n, dtype=np.int64)
            own[np.cumsum(parts) - parts] = parts
            size[lead == n, :n] = own
    return size


def backwards(back: np.ndarray) -> np.ndarray:
    """size[row, start] of the pieces of the path that backpointers (sizes by end) give."""
    rows, length = back.shape[0], back.shape[1] - 1
    size = np.zeros((rows, length), dtype=np.int64)
    at = np.full(rows, length)
    while (live := np.flatnonzero(at > 0)).size:
        n = back[live, at[live]]
        at[live] -= n
        size[live, at[live]] = n
    return size


def long_ids(model: Model, codes: np.ndarray) -> np.ndarray:
    """The ids of one long unit: the same table, a place at a time; what two pieces said is remembered."""
    if model.kind != BPE:
        ids = lattice(model, codes[None, :])
        return ids_of(model, codes[None, :], ids, viterbi(model, ids))[0]
    text, rules = "".join(map(chr, codes.tolist())), model.followers
    number = model.number | rules.symbols
    can: dict[tuple[int, int], bool] = {}
    last, back = [-1] * (len(text) + 1), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for size in range(1, min(model.longest, end) + 1):
            i = number.get(text[end - size : end], -1)
            if i < 0 and size > 1 or i >= 0 and not rules.made[i]:
                continue
            pair = last[end - size], i
            if min(pair) >= 0 and pair not in can:
                can[pair] = bool(rules.can(np.array([pair[0]]), np.array([pair[1]]))[0])
            if can.get(pair, True):
                last[end], back[end] = i, size
                break
    cuts = [len(text)]
    while cuts[-1]:
        cuts.append(cuts[-1] - back[cuts[-1]])
    parts = [text[a:b] for a, b in zip(cuts[:0:-1], cuts[-2::-1], strict=True)]
    lead = next((k for k, p in enumerate(parts) if p != "▁"), len(parts)) if rules.runs else 0
    parts[:lead] = ["▁" * n for n in rules.run_sizes(lead)]
    return np.array([i for p in parts for i in ([model.number[p]] if p in model.number else model.fallback(ord(p)))], dtype=np.int32)


class Known:
    """Ids of units by the units' hashes: sorted hashes, and for each where its ids are among all ids."""

    def __init__(self):
        self.keys, self.begin, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != keys)

    def add(self, keys: np.ndarray, n: np.ndarray, flat: np.ndarray) -> None:
        begin = len(self.flat) + np.cumsum(n) - n
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every)
        self.keys, self.begin, self.n, self.flat = every[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.n, n])[order], np.concatenate([self.flat, flat])

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after the other, and their numbers."""
        at = np.searchsorted(self.keys, keys)
        n = self.n[at]
        return self.flat[np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


def ids_of(model: Model, codes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, one after the other, and their numbers."""
    row, start = np.nonzero(size)
    found = ids[row, start, size[row, start] - 1]
    n = np.ones(len(found), dtype=np.int64)
    odd = np.flatnonzero(found < 0)
    if not len(odd):
        return found, np.bincount(row, minlength=len(codes))
    instead = [model.fallback(int(c)) for c in codes[row[odd], start[odd]].tolist()]
    n[odd] = [len(x) for x in instead]
    out = np.repeat(found, n)
    at = np.cumsum(n) - n
    for i, x in zip(at[odd].tolist(), instead, strict=True):
        out[i : i + len(x)] = x
    return out, np.bincount(row, weights=n, minlength=len(codes)).astype(np.int64)


def prepared(model: Model, text: str | None) -> str:
    if not text:
        return ""
    if model.squeeze:
        text = " ".join(x for x in text.split(" ") if x)
    return ("▁" if model.prefix and text else "") + text.replace(" ", "▁")


def encode_batch(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text's begin (with the end)."""
    ready = [prepared(model, t) for t in texts]
    codes = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in ready])]).astype(np.int64)
    if not len(codes):
        return np.zeros(0, np.int32), offsets
    head = np.zeros(len(codes), dtype=bool)
    head[offsets[:-1][offsets[:-1] < len(codes)]] = True
    if not model.whole:
        space, alone = codes == SPACE, ~model.joined[codes]
        head[1:] |= space[1:] & ~space[:-1]
        head |= alone
        head[1:] |= alone[:-1]
    start = np.flatnonzero(head)
    length = np.diff(np.append(start, len(codes)))
    values = K.mixed(codes.astype(np.uint64) + K.U64(0x1000000))
    keys, first, place = np.unique(K.RangeHash(values, 0x2545F4914F6CDD1D).of(start, start + length), return_index=True, return_inverse=True)
    if len(model.known.keys) > KNOWN:
        model.known = Known()
    new = model.known.missing(keys)
    model.known.add(*encoded_units(model, codes, keys[new], start[first[new]], length[first[new]]))
    ids, n = model.known.of(keys[place])
    unit_cuts = np.searchsorted(start, offsets)
    ends = np.concatenate([[0], np.cumsum(n)])[unit_cuts]
    if not model.bytes:
        again = np.zeros(len(ids), dtype=bool)
        again[1:] = (ids[1:] == model.unknown) & (ids[:-1] == model.unknown)
        again[ends[:-1][ends[:-1] < len(ids)]] = False
        ends -= np.concatenate([[0], np.cumsum(again)])[ends]
        ids = ids[~again]
    return ids, ends


def encoded_units(model: Model, codes: np.ndarray, keys: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of distinct units (ranges of codes), the numbers of their ids, and all ids, unit by unit."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(length > LONG).tolist():
        out = long_ids(model, codes[start[i] : start[i] + length[i]])
        parts.append((keys[i : i + 1], np.array([len(out)]), out))
    by_length = np.argsort(length, kind="stable")
    sizes, cuts = np.unique(length[by_length], return_index=True)
    cuts = np.append(cuts, len(length))
    for n, a, b in zip(sizes.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if n > LONG:
            break
        step = max(1, CELLS // (n * min(n, model.longest)))
        for x in range(a, b, step):
            units = by_length[x : min(b, x + step)]
            own = codes[start[units][:, None] + np.arange(n)]
            ids = lattice(model, own)
            out, per = ids_of(model, own, ids, table(model, own, ids) if model.kind == BPE else viterbi(model, ids))
            parts.append((keys[units], per, out))
    return tuple(np.concatenate([p[k] for p in parts] + [np.zeros(0, kind)]).astype(kind) for k, kind in enumerate((np.uint64, np.int64, np.int32)))


class Decoder:
    def __init__(self, model: Model):
        self.model = model
        back = {i: bytes([b]) for b, i in model.bytes.items()}
        normal = set(model.number.values())
        self.content = [back.get(i) or (p.replace("▁", " ").encode() if i in normal else " ⁇ ".encode() if i == model.unknown else b"") for i, p in enumerate(model.pieces)]

        self.size = np.array([len(c) for c in self.content])
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.flat = np.frombuffer(b"".join(self.content), np.uint8)

    def decode_batch(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of rows of ids (cuts: where each row's begin, with the end)."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.flat[np.repeat(self.begin[ids] - ends[:-1], size) + np.arange(int(ends[-1]))].tobytes()
        texts = [data[a:b] for a, b in zip(ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist(), strict=True)]
        return [t[1:] if self.model.prefix and t[:1] == b" " else t for t in texts]


_LOADED: dict[str, tuple[Model, Decoder]] = {}


def loaded(path: str) -> tuple[Model, Decoder]:
    if path not in _LOADED:
        model = Model(path)
        _LOADED[path] = model, Decoder(model)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, ids (array of int). path: the model file, found on every machine."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = loaded(path)
        for batch in batches:
            for part in K.slices(batch, "text", BATCH_BYTES):
                ids, cuts = encode_batch(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "text", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded's columns (doc_id, text, ids) with decoded, the text that ids stand for."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = loaded(path)
        for batch in batches:
            for part in K.slices(batch, "text", BATCH_BYTES):
                lists = part.column("ids").fill_null([])
                cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = decoder.decode_batch(lists.flatten().to_numpy(zero_copy_only=False), cuts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "text", "ids")), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "text", "ids", "decoded"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(run, f"doc_id {kind}, text string, ids array<int>, decoded string")


def summaries(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256, round_trip: encoded and decoded in one pass, so that ids don't leave the worker."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, decoder = loaded(path)
        for batch in batches:
            for part in K.slices(batch, "text", BATCH_BYTES):
                texts = part.column("text").to_pylist()
                ids, cuts = encode_batch(model, texts)
                back = decoder.decode_batch(ids, cuts)
                data = ids.astype("<i4").tobytes()
                digests = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(cuts), pa.int64()), pa.array(digests), pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([x == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(back, texts, strict=True)], pa.bool_())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
                )
            K.give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
