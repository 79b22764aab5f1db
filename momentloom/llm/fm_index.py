"""A bidirectional FM-index over a vocabulary, and a search for words at one edit.

The text is ``<word>`` after ``<word>``, one byte a character. Two transforms, of the text and of its reverse, each in a
wavelet matrix, give the interval of suffix ranks that start with a string, and that of the reversed string;
extending the string by a character on either side moves both together. A word at one edit from a pattern agrees with
it on one side of any cut, so the search matches one half exactly, from the cut outwards to the word's end, and then extends across
the other half with one error. All patterns of a batch are searched side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OPEN, CLOSE = 1, 2
_BITS = 8


def joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the delimited words, and the place of each opening delimiter. Words hold characters up to U+00FF."""
    text = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("latin-1"), np.uint8)
    return text, np.flatnonzero(text == OPEN)


def suffix_ranks(text: np.ndarray, last: int) -> np.ndarray:
    """Places of the suffixes in ascending order, compared up to the first ``last``, by doubling the compared length; then by place."""
    n = len(text)
    stop = np.where(text == last, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]  # a suffix is compared to here
    rank = text.astype(np.int64)
    k, longest = 1, int((stop - np.arange(n)).max(initial=0)) + 1
    while k < longest:
        at = np.arange(n) + k
        inside = at <= stop
        key = rank * (n + 257) + np.where(inside, rank[np.minimum(at, n - 1)] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1]
        k *= 2
    return np.argsort(rank, kind="stable")


class Wavelet:
    """Counts of bytes in prefixes of an array: all bits of a byte from the highest on, one stable partition per bit."""

    def __init__(self, values: np.ndarray):
        self.ones, self.zeros = [], []
        for b in range(_BITS - 1, -1, -1):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        every = np.arange(1 << _BITS)
        self.base = np.zeros(1 << _BITS, np.int64)
        self.base = self.within(every, 0 * every, 0 * every)[0]

    def within(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many values before each range equal ``c``; how many in it do, and how many are less."""
        less = np.zeros(len(lo), np.int64)
        for k in range(_BITS):
            bit = ((c >> (_BITS - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][lo].astype(np.int64), self.ones[k][hi].astype(np.int64)
            less += np.where(bit, (hi - b) - (lo - a), 0)
            lo, hi = np.where(bit, self.zeros[k] + a, lo - a), np.where(bit, self.zeros[k] + b, hi - b)
        return lo - self.base[c], hi - lo, less

    def distinct(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every value of every range: the number of its range, and the value."""
        owner, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for k in range(_BITS):
            a, b = self.ones[k][lo].astype(np.int64), self.ones[k][hi].astype(np.int64)
            some, none = b > a, (hi - b) > (lo - a)
            lo, hi = np.concatenate([(lo - a)[none], (self.zeros[k] + a)[some]]), np.concatenate([(hi - b)[none], (self.zeros[k] + b)[some]])
            owner = np.concatenate([owner[none], owner[some]])
            value = np.concatenate([value[none] * 2, value[some] * 2 + 1])
        return owner, value


@dataclass
class States:
    """Searches under way: pattern, next place in it, whether the error is spent, and both intervals."""

    query: np.ndarray
    place: np.ndarray
    spent: np.ndarray
    lo: np.ndarray
    back: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> States:
        return States(self.query[at], self.place[at], self.spent[at], self.lo[at], self.back[at], self.size[at])

    @staticmethod
    def stack(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("query", "place", "spent", "lo", "back", "size")))


class BiIndex:
    """The index of distinct words."""

    def __init__(self, words: list[str]):
        self.text, opens = joined(words)
        n = len(self.text)
        turned = self.text[::-1].copy()
        order = suffix_ranks(self.text, CLOSE)
        number = np.full(n, -1)
        number[opens] = np.arange(len(words))
        self.word = number[order]  # of the suffix of each rank, where it starts with a whole word
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=257))])
        # Before a suffix, and after the end of a reversed one; what stands before the first is never asked for.
        self.sides = Wavelet(self.text[order - 1]), Wavelet(turned[suffix_ranks(turned, OPEN) - 1])
        self.n = n

    def extend(self, s: States, c: np.ndarray, right: bool) -> States:
        """The searches with one more character, on the right or on the left; those without an occurrence are left out."""
        own = s.back if right else s.lo
        side = self.sides[int(right)]
        before, size, less = side.within(c, own, own + s.size)
        moved = self.starts[c] + before
        lo, back = (s.lo + less, moved) if right else (moved, s.back + less)
        return States(s.query, s.place, s.spent, lo, back, size).take(size > 0)

    def near(self, patterns: list[str], cut: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patterns and words at exactly one edit that agree up to ``cut`` where ``first``, else from ``cut`` on: numbers of both, each pair once."""
        out = [self._near([patterns[i] for i in at], cut[at], right, at) for right in (True, False) if len(at := np.flatnonzero(first == right))]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.unique(np.concatenate(out), axis=0)
        return found[:, 0], found[:, 1]

    def _near(self, patterns: list[str], cut: np.ndarray, right: bool, at: np.ndarray) -> np.ndarray:
        flat, opens = joined(patterns)
        ends = np.append(opens[1:], len(flat)) - 1  # of the closing delimiters
        cut = opens + 1 + cut
        n = len(patterns)
        whole = lambda place: States(np.arange(n), place, np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.n))
        # From the cut outwards to the end of the half that is matched exactly: against the direction of the error.
        s, step = whole(cut - 1 if right else cut), -1 if right else 1
        while True:
            going = s.place >= opens[s.query] if right else s.place <= ends[s.query]
            if not going.any():
                break
            done, s = s.take(~going), s.take(going)
            s = self.extend(s, flat[s.place].astype(np.int64), not right)
            s.place = s.place + step
            s = States.stack([done, s])
        # Across the other half, with one error: up to, but without, its delimiter.
        step = -step
        last = ends if right else opens
        s.place = cut[s.query] if right else cut[s.query] - 1
        ended = []
        while len(s.query):
            over = s.place == last[s.query]
            ended.append(s.take(over & s.spent))
            fresh = s.take(~s.spent)
            parts = [s.take(~over)]
            parts[0] = self.extend(parts[0], flat[parts[0].place].astype(np.int64), right)
            parts[0].place = parts[0].place + step
            if len(fresh.query):
                inside = fresh.take(fresh.place != last[fresh.query])  # leave out a character of the pattern
                parts.append(States(inside.query, inside.place + step, np.ones(len(inside.query), bool), inside.lo, inside.back, inside.size))
                own = fresh.back if right else fresh.lo
                owner, value = self.sides[int(right)].distinct(own, own + fresh.size)
                letter = value > CLOSE
                more = fresh.take(owner[letter])
                value = value[letter]
                more.spent = np.ones(len(value), bool)
                other = (flat[more.place] != value) & (more.place != last[more.query])
                swapped = self.extend(more.take(other), value[other], right)  # another character instead
                swapped.place = swapped.place + step
                parts += [swapped, self.extend(more, value, right)]  # one more character
            s = States.stack(parts)
        s = States.stack(ended) if ended else whole(cut).take(np.zeros(0, np.int64))
        s = self.extend(s, np.full(len(s.query), CLOSE if right else OPEN), right)
        word = self.word[s.lo]
        return np.stack([at[s.query], word], 1)
