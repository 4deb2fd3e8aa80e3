"""Hashes of words and of runs of words, of many texts at once, by differences of prefix sums."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters, or bytes, that may stand at a word's ends without being part of it.
MARKS = ".,;:!?\"'()[]"


def _flags(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_SPACE, _MARK = _flags(b"\t\n\v\f\r "), _flags(MARKS.encode())
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: What a byte, or the lower bits of a character, counts for.
VALUE = mixed(np.arange(1, 1 << 16 | 1, dtype=np.uint64))
_BLOCK = 1 << 12


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), as a block of powers times powers of the block's length."""
    inner = np.array([pow(base, i, 1 << 64) for i in range(_BLOCK)], np.uint64)
    outer = np.array([pow(base, _BLOCK * i, 1 << 64) for i in range(-(-n // _BLOCK))], np.uint64)
    return (outer[:, None] * inner).ravel()[:n]


class Sums:
    """Hashes of any substrings of a sequence of values."""

    _up, _down = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)

    def __init__(self, values: np.ndarray) -> None:
        self.sum = np.zeros(len(values) + 1, np.uint64)
        up, down = Sums._up, Sums._down
        if len(values) >= len(up):
            n = len(values) + (len(values) >> 2)
            up, down = _powers(_BASE, n), _powers(_INVERSE, n)
            # Kept for the next batch, unless one very long text asked for it.
            if n <= 1 << 22:
                Sums._up, Sums._down = up, down
        self.inverse = down
        np.cumsum(values * up[: len(values)], out=self.sum[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sum[end] - self.sum[start]) * self.inverse[start]


#: By a number of bytes, what is left of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Eights of a word that are read one after the other; of longer words, sums.
_EIGHTS = 8


def _by_eights(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte strings, each by its eights: of a text's words, some six times less work than by its bytes."""
    size = end - start
    room = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw), "<u8", room, strides=(1,))
    out = mixed(size.astype(np.uint64) * np.uint64(_BASE) ^ eight[start] & _FIRST[np.minimum(size, 8)])
    for i in range(1, _EIGHTS):
        some = np.nonzero(size > 8 * i)[0]
        if not len(some):
            return out
        out[some] = mixed(out[some] ^ eight[start[some] + 8 * i] & _FIRST[np.minimum(size[some] - 8 * i, 8)])
    some = np.nonzero(size > 8 * _EIGHTS)[0]
    n = size[some]
    first = np.cumsum(n) - n
    at = np.repeat(start[some] - first, n) + np.arange(int(n.sum()))
    out[some] = mixed(out[some] + Sums(VALUE[raw[at]]).hash(first, first + n))
    return out


class Words:
    """The words, runs without ASCII white space, of some texts: text is each one's text, hash what stands for it,
    count how many a text has, first its first one. With `lower`, ASCII letters count as lower ones; with `trim`,
    marks at a word's ends don't count, unless it is nothing else. With `eights`, hashes are others, sooner there."""

    def __init__(self, texts: list[str], lower: bool = False, trim: bool = False, eights: bool = False) -> None:
        body = [t.encode() for t in texts]
        raw = np.frombuffer(b"\n".join([*body, b""]), np.uint8)
        if lower:
            raw = _LOWER[raw]
        at = np.nonzero(np.diff(_SPACE[raw], prepend=True))[0]
        start, end = at[::2], at[1::2]
        ends = np.cumsum(np.fromiter(map(len, body), np.int64, len(body)) + 1) - 1
        upto = np.searchsorted(start, ends)
        self.count = np.diff(upto, prepend=0)
        self.first = upto - self.count
        self.text = np.repeat(np.arange(len(texts)), self.count)
        if trim and len(start):
            place = np.arange(len(raw))
            plain = ~_MARK[raw]
            after = np.minimum.accumulate(np.where(plain, place, len(raw))[::-1])[::-1][start]
            before = np.maximum.accumulate(np.where(plain, place, -1))[end - 1] + 1
            some = after < end
            start, end = np.where(some, after, start), np.where(some, before, end)
        if eights:
            self.hash = _by_eights(raw, start, end)
            return
        self.hash = mixed(Sums(VALUE[raw]).hash(start, end) + (end - start).astype(np.uint64)) if len(start) else np.empty(0, np.uint64)

    def runs(self, width: int) -> np.ndarray:
        """The hash of each run of `width` words, from each word on; those that leave their text mean nothing."""
        h, out = self.hash, np.zeros(len(self.hash), np.uint64)
        n = max(0, len(h) - width + 1)
        for i in range(width):
            out[:n] = out[:n] * np.uint64(_BASE) + h[i : i + n]
        return mixed(out)

    def places(self) -> np.ndarray:
        """Each word's number in its text."""
        return np.arange(len(self.hash)) - self.first[self.text]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each run of `width` words; of all words of a text that has fewer."""
        out, short = self.runs(width), self.count < width
        for n in range(1, width):
            some = self.first[short & (self.count == n)]
            h = np.zeros(len(some), np.uint64)
            for i in range(n):
                h = h * np.uint64(_BASE) + self.hash[some + i]
            out[some] = mixed(h + np.uint64(n))
        keep = self.places() < np.maximum(1, self.count - width + 1)[self.text]
        return self.text[keep], out[keep]


def smallest(h: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of each `reach` neighbours, from each one on; the last ones have fewer."""
    low, have = h.copy(), 1
    while have < reach:
        step = min(have, reach - have)
        if step >= len(low):
            break
        low[:-step] = np.minimum(low[:-step], low[step:])
        have += step
    return low


def unpacked(body: bytes, *sizes: int) -> list[np.ndarray]:
    """The columns of a block, of rows of these sizes, as unsigned 64-bit numbers."""
    n, raw, at, out = len(body) // sum(sizes), np.frombuffer(body, np.uint8), 0, []
    for size in sizes:
        c = np.zeros((n, 8), np.uint8)
        c[:, :size] = raw[at : at + n * size].reshape(n, size)
        out.append(c.view("<u8").ravel())
        at += n * size
    return out


def dealt(key: np.ndarray, buckets: int, *columns: tuple[np.ndarray, int]):
    """(bucket, block) for each bucket, which is the key modulo their number. A block has the columns of its rows, one
    after the other, of each the given number of lowest bytes."""
    if not len(key):
        return
    bucket = (key % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    raw = [c[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].copy() for c, n in columns]
    cut = [0, *(np.nonzero(bucket[1:] != bucket[:-1])[0] + 1).tolist(), len(bucket)]
    for i, j in zip(cut, cut[1:], strict=False):
        yield int(bucket[i]), b"".join([c[i:j].tobytes() for c in raw])
