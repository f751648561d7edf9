"""MD5 of the pairs of prefixes and suffixes, of which only low ones count: numpy goes through many at once."""

from __future__ import annotations

import math

import numpy as np

#: A longer text has more than one block.
MOST_BYTES = 55
K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
TURN = [np.uint32(x) for x in [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4]
BACK = [np.uint32(32 - x) for x in TURN]
WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The first word of a digest is final after this many steps.
STEPS = 61
#: Texts that are gone through at once, so that all words of their state stay in a core's cache; suffixes among them.
AT_ONCE, SUFFIXES = 1 << 14, 1 << 12


def words(texts: np.ndarray, before: int, end: bool) -> np.ndarray:
    """Rows of the 16 words of a block that holds a text (a row of bytes) after `before` bytes, with the end mark or without."""
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, before : before + texts.shape[1]] = texts
    if end:
        block[:, before + texts.shape[1]] = 0x80
    return block.view("<u4").astype(np.uint32)


def heads(prefix: np.ndarray, suffix: dict[int, np.ndarray], bits: int) -> np.ndarray:
    """First 32 bits of the digests of each prefix (a row of 16 words) with each suffix (its words by number, where it has any)."""
    p = [prefix[:, i : i + 1] if prefix[:, i].any() else None for i in range(14)] + [np.uint32(bits), None]
    a, b, c, d = (np.full((1, 1), x, np.uint32) for x in START)
    full = (len(prefix), len(next(iter(suffix.values()))))
    f = t = None
    for i in range(STEPS):
        if t is None and a.shape == full:
            # The first words may be the same for all suffixes. From here on all have their full size and are used again.
            f, t = np.empty_like(a), np.empty_like(a)
        if i < 16:
            f = np.bitwise_xor(c, d, out=f)
            f = np.bitwise_xor(np.bitwise_and(f, b, out=t if t is None else f), d, out=t if t is None else f)
        elif i < 32:
            f = np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        n, k = WORD[i], K[i]
        f = np.add(f, a, out=t if t is None else f)
        if n not in suffix:
            f = np.add(f, k if p[n] is None else p[n] + k, out=t if t is None else f)
        else:
            f = np.add(f, suffix[n] + k, out=t if t is None else f)
            if p[n] is not None:
                # Their bits are apart.
                f = np.add(f, p[n], out=t if t is None else f)
        if t is None:
            a, b, c, d, f = d, b + ((f << TURN[i]) | (f >> BACK[i])), b, c, None
        else:
            np.left_shift(f, TURN[i], out=t)
            np.right_shift(f, BACK[i], out=f)
            np.bitwise_or(f, t, out=f)
            np.add(f, b, out=f)
            a, b, c, d, f = d, f, b, c, a
    np.add(b, np.uint32(START[0]), out=b)
    return b.byteswap(inplace=True)


def low_pairs(prefix: np.ndarray, start: np.ndarray, suffix: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """x, y: a prefix and a suffix (rows of bytes) from start[x] on, whose text has a digest of first 32 bits up to limit.

    start must not fall. A text has MOST_BYTES at most.
    """
    p, s, bits = words(prefix, 0, False), words(suffix, prefix.shape[1], True), 8 * (prefix.shape[1] + suffix.shape[1])
    used = [i for i in range(14) if s[:, i].any()]
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for low in range(0, len(s), SUFFIXES):
            high = min(low + SUFFIXES, len(s))
            columns, i, last = {n: np.ascontiguousarray(s[low:high, n]) for n in used}, 0, np.searchsorted(start, high)
            while i < last:
                k = max(low, int(start[i]))
                j = min(last, i + max(1, AT_ONCE // (high - k)))
                x, y = np.nonzero(heads(p[i:j], {n: c[k - low :] for n, c in columns.items()}, bits) <= limit)
                x, y = x + i, y + k
                xs.append(x[y >= start[x]])
                ys.append(y[y >= start[x]])
                i = j
    return np.concatenate(xs), np.concatenate(ys)
