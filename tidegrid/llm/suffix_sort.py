"""Suffix sorting by induction (Nong, Zhang and Chan, 2009) and permuted common prefixes, in numpy.

Suffixes are larger (L) or smaller (S) than the one behind them; leftmost-smaller ones (LMS) begin an S run. The
substrings between LMS places are sorted by induction and named, the string of names is sorted by the same function,
one level down, and the order found there is induced back up. A level's alphabet may have hundreds of thousands of
letters, so buckets are taken in runs of neighbouring letters in which none puts a suffix into another: numpy then
handles a run at once. How far such runs reach is known before, from the letter pairs of the text; there are about as
many as the square root of its length.
"""

from __future__ import annotations

import numpy as np

#: Places at which a common prefix is counted from nothing; those between start from the place before.
SPARSE = 64


def _equal_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values; x has at least one."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    firsts = new.nonzero()[0]
    counts = np.empty_like(firsts)
    np.subtract(firsts[1:], firsts[:-1], out=counts[:-1])
    counts[-1] = len(x) - firsts[-1]
    return firsts, counts


class _Induction:
    def __init__(self, t: np.ndarray):
        """t: codes from 0; the last one is 0 and the only one."""
        n = len(t)
        self.t = t = t.astype(np.uint16 if t.max() < 1 << 16 else np.int32)  # numpy sorts 16 bits by radix
        steps = np.flatnonzero(t[1:] != t[:-1])
        self.begin = np.zeros(n, np.int64)  # where the run of equal letters begins
        self.begin[steps + 1] = steps + 1
        np.maximum.accumulate(self.begin, out=self.begin)
        self.smaller = np.ones(n, bool)
        self.smaller[:-1] = np.repeat(t[steps] < t[steps + 1], np.diff(steps, prepend=-1))
        self.lms = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1
        self.sizes = np.bincount(t)
        self.tails = np.cumsum(self.sizes)
        self.heads = self.tails - self.sizes
        self.up, self.down = self._letter_runs()

    def _letter_runs(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Half-open runs of letters for the pass over L suffixes, and, from the top, for the one over S suffixes."""
        t, k = self.t, len(self.sizes)
        before, after, smaller = t[:-1], t[1:], self.smaller[:-1]
        # a run may not hold a letter and one that it puts suffixes into: least such letter for each, from it on
        lowest = np.full(k + 1, k, np.int64)
        some = ~smaller & (before > after)
        np.minimum.at(lowest, after[some], before[some])
        ends = np.minimum.accumulate(lowest[::-1])[::-1]
        up, at = [], 0
        while at < k:
            up.append((at, int(ends[at])))
            at = up[-1][1]
        highest = np.full(k + 1, -1, np.int64)
        some = smaller & (before < after)
        np.maximum.at(highest, after[some], before[some])
        starts = np.maximum.accumulate(highest)
        down, at = [], k
        while at > 0:
            down.append((int(starts[at - 1]) + 1, at))
            at = down[-1][0]
        return up, down

    def _deal(self, sa: np.ndarray, at: np.ndarray, where: np.ndarray, down: bool) -> None:
        """Append the suffixes `at`, in turn, to the ends `where` of their buckets."""
        if not len(at):
            return
        letter = self.t[at]
        order = letter.argsort(kind="stable")
        letter, at = letter[order], at[order]
        firsts, counts = _equal_runs(letter)
        nth = np.arange(len(at)) - np.repeat(firsts, counts)
        if down:
            sa[where[letter] - 1 - nth] = at
            where[letter[firsts]] -= counts
        else:
            sa[where[letter] + nth] = at
            where[letter[firsts]] += counts

    def _induce(self, sa: np.ndarray, lo: int, hi: int, where: np.ndarray, down: bool) -> None:
        """Put the suffixes before those of the buckets lo to hi into their buckets."""
        span = slice(self.heads[lo], self.tails[hi - 1])
        fits = self.smaller if down else ~self.smaller
        some = sa[span]
        some = some[some > 0] - 1
        some = some[fits[some]]
        if not len(some):
            return
        same = self.t[some] == self.t[some + 1]
        own = some[same]
        if not len(own):
            self._deal(sa, some[::-1] if down else some, where, down)
            return
        # what a bucket puts into itself: in turn the first, second and further letters before it that are equal
        own = own[::-1] if down else own
        counts = own - self.begin[own] + 1
        if counts.max() > 1:
            nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            order = nth.argsort(kind="stable")
            own = (np.repeat(own, counts) - nth)[order]
        self._deal(sa, own, where, down)
        some = sa[span]
        some = some[some > 0] - 1
        some = some[fits[some] & (self.t[some] != self.t[some + 1])]
        self._deal(sa, some[::-1] if down else some, where, down)

    def run(self, lms: np.ndarray) -> np.ndarray:
        """Suffix array induced from the LMS suffixes in the order given."""
        n, sa = len(self.t), np.full(len(self.t), -1, np.int64)
        self._deal(sa, lms[::-1], self.tails.copy(), True)
        heads, tails = self.heads.copy(), self.tails.copy()
        for lo, hi in self.up:
            self._induce(sa, lo, hi, heads, False)
        found = sa[sa >= 0]
        found = found[~self.smaller[found]]  # S suffixes are now induced from the L ones
        sa[:] = -1
        self._deal(sa, found, self.heads.copy(), False)
        sa[0] = n - 1  # the end mark has nothing behind it to be induced from
        tails[0] = 0
        for lo, hi in self.down:
            self._induce(sa, lo, hi, tails, True)
        return sa

    def names(self, ordered: np.ndarray) -> np.ndarray:
        """Ranks, in text order, of the LMS substrings, given their order; equal ones share a rank."""
        t, ends = self.t, np.append(self.lms[1:], len(self.t) - 1)
        number = np.empty(len(t), np.int64)
        number[self.lms] = np.arange(len(self.lms))
        sizes = ends[number[ordered]] - ordered
        same = sizes[1:] == sizes[:-1]
        a, b, left, at = ordered[1:], ordered[:-1], np.flatnonzero(same), 0
        while len(left):
            equal = t[a[left] + at] == t[b[left] + at]
            same[left[~equal]] = False
            left = left[equal]
            at += 1
            left = left[sizes[left] >= at]
        ranks = np.concatenate([[0], np.cumsum(~same)])
        out = np.empty(len(self.lms), np.int64)
        out[number[ordered]] = ranks
        return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of the suffixes of t in order. t: codes from 0, of which the last is 0 and the only one."""
    if len(t) < 3:
        return np.arange(len(t))[::-1].copy()
    level = _Induction(t)
    ordered = level.run(level.lms)
    is_lms = np.zeros(len(t), bool)
    is_lms[level.lms] = True
    ordered = ordered[is_lms[ordered]]
    names = level.names(ordered)
    if names.max() + 1 < len(names):
        ordered = level.lms[suffix_array(names)]
    return level.run(ordered)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of text, in text order: letters that its suffix shares with the one before it in the suffix
    array `order`, at most `most` (Kaerkkaeinen, Manzini and Puglisi, 2009). The first suffix shares none.

    A place shares at least what the place before it does, less one. So the shares of every SPARSE-th place are counted
    from nothing and those of the places behind them, all at once, from that bound; eight letters at a time.
    """
    n = len(text)
    size = (n + most + 16) // 8 * 8
    padded = np.zeros(size + 8, np.uint8)
    padded[:n] = text
    words = np.empty(size, "<u8")  # the eight letters from each place on
    for r in range(8):
        words[r::8] = padded[r : r + size].view("<u8")
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    shared = np.zeros(n, np.int64)
    for first in range(min(SPARSE, n)):
        at = np.arange(first, n, SPARSE)
        known = np.maximum(shared[at - 1] - 1, 0) if first else np.zeros(len(at), np.int64)
        left = np.flatnonzero(before[at] >= 0)
        while len(left):
            a, b = at[left] + known[left], before[at[left]] + known[left]
            differ = words[a] ^ words[b]
            lowest = differ & (~differ + np.uint64(1))
            known[left] += np.where(differ == 0, 8, (np.bitwise_count(lowest - np.uint64(1)) // 8).astype(np.int64))
            left = left[(differ == 0) & (known[left] < most)]
        shared[at] = np.minimum(known, np.minimum(most, n - at))
        shared[at] = np.where(before[at] >= 0, np.minimum(shared[at], n - before[at]), 0)
    return shared
