"""Edit distances up to a bound, by bit-parallel columns of a diagonal band: for two sequences, and for many pairs at once."""

from __future__ import annotations

import numpy as np


def within(a: str, b: str, tau: int) -> bool:
    """Whether two texts are within tau edits: common ends go, then bit-parallel columns of a band, ended early."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > tau:
        return False
    n = min(len(a), len(b))
    i = _common(a, b, n)
    a, b = a[i:], b[i:]
    j = _common(a[::-1], b[::-1], n - i)
    if j:
        a, b = a[:-j], b[:-j]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= tau
    return _banded(a, b, tau)


def _common(a: str, b: str, n: int) -> int:
    """The length of the common beginning, n at most."""
    lo, hi = 0, n
    while lo < hi:
        k = (lo + hi + 1) // 2
        if a[lo:k] == b[lo:k]:
            lo = k
        else:
            hi = k - 1
    return lo


_WORD = (1 << 64) - 1


def _banded(a: str, b: str, tau: int) -> bool:
    """a is not longer than b. A window of b's differences, of 64 bits or what tau takes, moves down the diagonal, one
    column for each of a."""
    if len(b) <= tau:
        return True
    if len(b) == tau + 1:
        return _plain(a, b) <= tau
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | 1 << i
    top = max(63, 2 * tau + 1)
    word = _WORD if top == 63 else (2 << top) - 1
    vp, vn, cost = word << (top - tau) & word, 0, tau
    start, most, down = tau - top, 2 * tau + len(a) - len(b), 1 << top - 1
    for i, ch in enumerate(a):
        found = where.get(ch, 0)
        x = (found << -start if start < 0 else found >> start) & word
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & word
        hp, hn = (vn | ~(d0 | vp)) & word, d0 & vp
        if i < len(b) - tau:
            cost += not d0 >> top
        else:
            cost += bool(hp & down) - bool(hn & down)
            down >>= 1
        if cost > most:
            return False
        vp, vn = (hn | ~(d0 >> 1 | hp)) & word, d0 >> 1 & hp
        start += 1
    return cost <= tau


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def within_pairs(symbols: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Whether rows x[k] and y[k] of symbols (padded with -1; `length` symbols each) are within tau[k] edits, for each k.

    As _banded, with a column's step for all pairs of a block together. x[k] mustn't be longer than y[k], nor shorter
    by more than tau[k]; the band, 2 tau + 1 differences, must fit 64 bits. A block has pairs of like lengths; its band
    is that of its largest tau, within which distances are exact.
    """
    out = np.empty(len(x), bool)
    room = np.searchsorted(_BANDS, tau)
    order = np.lexsort((length[x], room))
    n, room = length[x][order], room[order]
    i = 0
    while i < len(order):
        # As far as lengths and bands are alike, and no more than eight million comparisons together.
        upto = int(np.searchsorted(room, room[i], side="right"))
        upto = i + int(np.searchsorted(n[i:upto], n[i] * 1.25 + 8, side="right"))
        j = min(upto, i + max(1, (1 << 23) // ((int(n[i]) + 64) * (2 * int(_BANDS[room[i]]) + 9))))
        k = order[i:j]
        out[k] = _columns(symbols, length, x[k], y[k], int(tau[k].max())) <= tau[k]
        i = j
    return out


_BANDS = np.array([3, 6, 11, 19, 31])


def _columns(symbols: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray, tau: int) -> np.ndarray:
    """The pairs' distances, exact up to tau."""
    la, lb = length[x].astype(np.int64), length[y].astype(np.int64)
    longest = int(lb.max(initial=0))
    pad = np.full((tau, len(x)), -2, symbols.dtype)
    a = np.ascontiguousarray(symbols[x, : int(la.max(initial=0))].T)
    # Rows before the first and after the last symbol match nothing.
    b = np.concatenate([pad, np.where(np.arange(longest)[:, None] < lb, symbols[y, :longest].T, -2), pad, pad])
    # By column and pair, the band's rows that equal the column's symbol, as bits.
    band = np.lib.stride_tricks.sliding_window_view(b, 2 * tau + 1, axis=0)[: len(a)]
    bits = np.packbits(band == a[:, :, None], axis=-1, bitorder="little")
    match = np.zeros((*a.shape, 8), np.uint8)
    match[:, :, : bits.shape[-1]] = bits
    match = match.view("<u8")[:, :, 0]
    one, top = np.uint64(1), np.uint64(2 * tau)
    vp, vn = np.full(len(x), (1 << (tau + 1)) - 1 << tau, np.uint64), np.zeros(len(x), np.uint64)
    word = np.uint64((1 << (2 * tau + 1)) - 1)
    cost, down = np.full(len(x), tau), np.full(len(x), top - one, np.uint64)
    for i in range(len(a)):
        m = match[i]
        d0 = ((((m & vp) + vp) ^ vp) | m | vn) & word
        hp, hn = (vn | ~(d0 | vp)) & word, d0 & vp
        on, inside = i < la, i < lb - tau
        slant = 1 - (d0 >> top & one).astype(np.int64)
        flat = (hp >> down & one).astype(np.int64) - (hn >> down & one).astype(np.int64)
        cost += np.where(on, np.where(inside, slant, flat), 0)
        down = np.where(inside | (down == 0), down, down - one)
        vp, vn = (hn | ~(d0 >> one | hp)) & word, d0 >> one & hp
    return cost
