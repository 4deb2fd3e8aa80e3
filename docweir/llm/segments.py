"""The keys by which lines within an edit threshold meet: segments on one side, substrings on the other.

The threshold of a pair is that of its shorter line. With fewer than LONG words it counts edits of characters: a tenth
of the line's, two at most. From LONG words on it counts edits of words (runs without ASCII white space): a tenth of
the line's. So it grows with the line, and a tenth of anything is never below two words there.

A line of threshold tau is cut into tau + 1 segments, of which one is whole in every line within tau edits.

- Characters: the line is indexed under each segment; a line that isn't shorter probes, for each length it may meet,
  with its substrings at the places that the lengths and the segment's number leave.
- Words: there are many segments, and the places that are left grow with tau's square. So a segment is indexed under
  the smallest hash of its runs of GRAM words, and a line probes with the smallest hash of each stretch of its own that
  is as long as the shortest segment it may meet. Wherever a segment lies whole in the line, its smallest hash is also
  that of some stretch inside: the pair meets, always, at places that differ by tau at most, as edits before the
  segment move it no farther.

Everything is computed for all lines of a batch at once, with hashes of substrings taken as differences of prefix sums.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from docweir.llm.hashing import VALUE, Sums, Words, mixed

#: From this many words on, edits are of words.
LONG = 20
#: One edit for each so many symbols of the shorter line.
SHARE = 10
#: The most edits in lines of fewer than LONG words.
EDITS = 2
GRAM = 4

_NONE = np.iinfo(np.uint64).max


def threshold(chars: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The edits allowed in pairs whose shorter line has so many characters and words."""
    return np.where(words >= LONG, words // SHARE, np.minimum(EDITS, chars // SHARE))


def cuts(length: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, number, start, size) of the tau + 1 segments, as equal as can be, of each line; the longer ones last."""
    parts = tau + 1
    line = np.repeat(np.arange(len(length)), parts)
    number = np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)
    size, short = (length // parts)[line], (parts - length % parts)[line]
    return line, number, number * size + np.maximum(0, number - short), size + (number >= short)


@lru_cache(8)
def _stretches(most: int) -> np.ndarray:
    """By length, how many runs of GRAM words the shortest segment has of any line that one of this length may meet."""
    n = np.arange(most + 1)
    tau = n // SHARE
    out, least = np.zeros(most + 1, np.int64), n // (tau + 1) - GRAM + 1
    for l in range(LONG, most + 1):
        # Lengths l to l + l // SHARE meet a line of length l.
        part = out[l : l + l // SHARE + 1]
        np.minimum(np.where(part == 0, least[l], part), least[l], out=part)
    return out


class Lines:
    """Distinct lines of a batch: chars and words of each, and words as numbers from hashes."""

    def __init__(self, lines: list[str]) -> None:
        self.lines = lines
        own = Words(lines, eights=True)
        self.chars = np.fromiter(map(len, lines), np.int64, len(lines))
        self.word_line, self.words, self.word, self.first = own.text, own.count, own.hash, own.first
        self.grams = own.runs(GRAM)
        self.tau = threshold(self.chars, self.words)
        self.by_words = self.words >= LONG

    def symbols(self, pick: np.ndarray, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
        """(a row of numbers for each of some lines, padded with -1; their lengths): of words or of characters."""
        n = (self.words if by_words else self.chars)[pick]
        on = np.arange(int(n.max(initial=0))) < n[:, None]
        out = np.full(on.shape, -1, np.int32)
        if by_words:
            at = np.repeat(self.first[pick] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out[on] = np.unique(self.word[at], return_inverse=True)[1]
        else:
            out[on] = np.frombuffer("".join([self.lines[i] for i in pick.tolist()]).encode("utf-32-le"), np.int32)
        return out, n

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(by characters, by words): eight counts, mod 16, as 32 bits. An edit moves two of them by one at most."""
        line, code, n = *self._characters(), len(self.lines)
        return _packed(line, code & 7, n), _packed(self.word_line, (self.word >> np.uint64(61)).astype(np.int64), n)

    def many_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """As counts, 64 for each line, up to 32,767, a row of each."""
        line, code, n = *self._characters(), len(self.lines)
        which = (line * 64 + (code * 0x9E3779B1 >> 26 & 63), self.word_line * 64 + (self.word >> np.uint64(58)).astype(np.int64))
        by = (np.minimum(np.bincount(w, minlength=64 * n), 32767).astype(np.int16).reshape(n, 64) for w in which)
        return tuple(by)

    def _characters(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, code point) of each character of lines that can be in a pair by characters."""
        pick = np.nonzero(self.words < LONG + EDITS)[0]
        code = np.frombuffer("".join([self.lines[i] for i in pick.tolist()]).encode("utf-32-le"), np.uint32).astype(np.int64)
        return np.repeat(pick, self.chars[pick]), code


def _packed(line: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    c = np.bincount(line * 8 + which, minlength=8 * n).reshape(-1, 8).astype(np.uint32) & np.uint32(15)
    return (c << (np.arange(8, dtype=np.uint32) * np.uint32(4))).sum(1, dtype=np.uint32)


#: Columns of keys: the key, of 48 bits, the line, whether it probes, whether edits are of words, the place in the line:
#: 0 where the key has it already, 65,535 at most.
Keys = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_PLACE = np.uint64((1 << 16) - 1)


def keys(own: Lines) -> Keys:
    """All keys of the lines."""
    parts = [*_by_chars(own), *_by_words(own)]
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.empty(0, k) for i, k in enumerate((np.uint64, np.int64, bool, bool, np.int64)))


def _by_chars(own: Lines) -> list[Keys]:
    """Lines of up to EDITS words more than LONG - 1 can be within EDITS characters of one of fewer than LONG words."""
    pick = np.nonzero((own.words < LONG + EDITS) & (own.chars >= SHARE))[0]
    if not len(pick):
        return []
    code = np.frombuffer("".join([own.lines[i] for i in pick.tolist()]).encode("utf-32-le"), np.uint32)
    sums = Sums(VALUE[code & 0xFFFF] + code)
    n = own.chars[pick]
    first = np.cumsum(n) - n
    out: list[Keys] = []

    def add(line: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, number: np.ndarray | int, probe: bool) -> None:
        h = sums.hash(first[line] + start, first[line] + start + size)
        h = mixed(h + (length * (EDITS + 1) + number + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        out.append((h >> np.uint64(16), pick[line], np.full(len(line), probe), np.zeros(len(line), bool), np.zeros(len(line), np.int64)))

    line, number, start, size = cuts(n, np.minimum(EDITS, n // SHARE))
    add(line, start, size, n[line], number, False)
    for delta in range(EDITS + 1):
        length = n - delta
        some = np.nonzero((length >= SHARE) & (np.minimum(EDITS, length // SHARE) >= delta))[0]
        tau = np.minimum(EDITS, length[some] // SHARE)
        line, number, start, size = cuts(length[some], tau)
        line, tau = some[line], tau[line]
        low = np.maximum(0, np.maximum(start - number, start + delta - (tau - number)))
        high = np.minimum(n[line] - size, np.minimum(start + number, start + delta + (tau - number)))
        for step in range(2 * EDITS + 1):
            on = np.nonzero(low + step <= high)[0]
            add(line[on], low[on] + step, size[on], length[line[on]], number[on], True)
    return out


def _by_words(own: Lines) -> list[Keys]:
    pick = np.nonzero(own.by_words)[0]
    if not len(pick):
        return []
    gram = own.grams[own.by_words[own.word_line]]
    n = own.words[pick]
    first = np.cumsum(n) - n
    line = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(gram)) - first[line]
    # Of equal hashes the first one is the smallest, on both sides.
    gram = gram & ~_PLACE | np.minimum(at.astype(np.uint64), _PLACE)
    # Segments.
    who, _, start, size = cuts(n, n // SHARE)
    bounds = np.stack([first[who] + start, first[who] + start + size - GRAM + 1], 1).ravel()
    least = np.minimum.reduceat(np.append(gram, _NONE), bounds)[::2]
    # Stretches.
    reach = _stretches(1 << int(n.max()).bit_length())[n]
    low, span, best = gram.copy(), reach[line], np.full(len(gram), _NONE)
    for t in range(1, int(reach.max()) + 1):
        if t > 1:
            np.minimum(low[: 1 - t], gram[t - 1 :], out=low[: 1 - t])
        on = span == t
        best[on] = low[on]
    ok = at <= (n - GRAM + 1 - reach)[line]
    new = np.ones(len(gram), bool)
    new[1:] = (best[1:] != best[:-1]) | (at[1:] == 0)
    found = np.nonzero(ok & new)[0]
    rows = [(least, pick[who], False), (best[found], pick[line[found]], True)]
    return [(h >> np.uint64(16), k, np.full(len(h), probe), np.ones(len(h), bool), (h & _PLACE).astype(np.int64)) for h, k, probe in rows]


def allowed(shorter: np.ndarray, longer: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Whether lines of these lengths, in the symbols of their key, may be within tau edits."""
    return (shorter <= longer) & (longer - shorter <= tau)
