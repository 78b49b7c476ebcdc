"""A compressed FM-index over code points, and windows that occur in more than one owner.

The suffixes are ordered by their first symbols only (``ORDER`` unless told). Backward search
is exact for patterns up to that length: suffixes before the range of a pattern
differ from it within its length, and putting one symbol before both keeps that
order. Occurrences are counted on a wavelet matrix of packed bits with one
running count per word.
"""

from __future__ import annotations

import numpy as np

#: Suffixes are sorted by this many symbols at least.
ORDER = 256


def suffix_order(t: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Starts of the suffixes of ``t`` (small whole numbers), sorted by their first ``order`` symbols."""
    n = len(t)
    key = t.astype(np.int64)
    padded = np.concatenate([key, np.zeros(4, np.int64)])
    if n and key.max() < 1 << 15:
        key = (padded[:n] << 45) | (padded[1 : n + 1] << 30) | (padded[2 : n + 2] << 15) | padded[3 : n + 3]
        k = 4
    else:
        k = 1
    sa = np.argsort(key, kind="stable")
    while True:
        new = np.empty(n, bool)
        if n:
            s = key[sa]
            new[0], new[1:] = True, s[1:] != s[:-1]
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(new)
        if k >= order or n == 0 or new.all():
            return sa
        nxt = np.zeros(n, np.int64)
        nxt[:-k] = rank[k:]
        key = rank << 32 | nxt
        # Only suffixes that still tie with a neighbour are sorted again, each within its own group.
        tied = ~new
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if len(at) == 0:
            return sa
        part = sa[at]
        sa[at] = part[np.argsort(key[part], kind="stable")]
        k *= 2


class WaveletMatrix:
    """Rank of any symbol at any place, in one bit and a half per place and level."""

    def __init__(self, s: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        n = len(s)
        base = np.zeros(sigma, np.int64)
        symbols = np.arange(sigma)
        for level in reversed(range(self.levels)):
            bit = (s >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - n % 64, bool)]), bitorder="little").view(np.uint64)
            count = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=count[1:])
            self.words.append(packed)
            self.counts.append(count)
            self.zeros.append(n - int(bit.sum()))
            base = self._down(base, symbols >> level & 1, len(self.words) - 1)
            s = np.concatenate([s[~bit], s[bit]])
        self.base = base

    def _down(self, i: np.ndarray, bit: np.ndarray, k: int) -> np.ndarray:
        word = i >> 6
        below = self.words[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        ones = self.counts[k][word] + np.bitwise_count(below)
        return np.where(bit, self.zeros[k] + ones, i - ones)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs before ``i``."""
        for k in range(self.levels):
            i = self._down(i, c >> (self.levels - 1 - k) & 1, k)
        return i - self.base[c]


class FMIndex:
    """Segments of text, each with an owner (or several, given as ``MANY``)."""

    #: The owner of segments that stand in more than one record.
    MANY = -1

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray, order: int = ORDER) -> None:
        self.order = order
        sizes = np.array([len(x) for x in segments], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        points = np.zeros(int((sizes + 1).sum()), np.uint32)
        for a, x in zip(self.starts, segments):
            points[a : a + len(x)] = x
        kinds, symbols = np.unique(points, return_inverse=True)
        body = np.zeros(len(points), bool)
        for a, n in zip(self.starts, sizes):
            body[a : a + n] = True
        # 0 stands between segments and nowhere else.
        self.text = np.where(body, symbols.astype(np.int64) + 1, 0)
        self.sizes, self.owners = sizes, owners
        self.sa = suffix_order(self.text, order)
        bwt = self.text[self.sa - 1]
        sigma = len(kinds) + 1
        self.wm = WaveletMatrix(bwt, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=sigma))])[:-1]
        of_place = np.repeat(owners, sizes + 1)
        self.owner = of_place[self.sa]
        n = len(self.owner)
        change = np.flatnonzero(self.owner[1:] != self.owner[:-1]) + 1
        #: For each place in suffix order the next one with another owner.
        self.differs = np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")] if n else np.zeros(0, np.int64)

    def shared_windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of ``width`` symbols that also occur under another owner.

        Gives ``segment, first, last``: every window of the segment starting from
        ``first`` to ``last``. Each window is searched backwards from its end. If
        the search fails at ``j``, no window that starts up to ``j`` and holds the
        stretch from ``j`` on can be shared, so the next one starts at ``j + 1``. If
        it succeeds, the match is followed to the right beside one occurrence of
        another owner, and the next window is the first that leaves it.
        """
        if width > self.order:
            raise ValueError("windows are longer than the order of the index")
        seg = np.flatnonzero(self.sizes >= width)
        owner = self.owners[seg]
        base, last = self.starts[seg], self.sizes[seg] - width
        s = np.zeros(len(seg), np.int64)
        j = np.full(len(seg), width, np.int64)
        lo, hi = np.zeros(len(seg), np.int64), np.full(len(seg), len(self.text), np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(seg):
            j = j - 1
            c = self.text[base + j]
            both = self.wm.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            at = np.minimum(lo, len(self.owner) - 1)
            here = self.owner[at]
            other = (here != owner) | (here == self.MANY)
            ok = (lo < hi) & (other | (self.differs[at] < hi))
            done = ok & (j == s)
            restart = ~ok
            nxt = np.where(restart, j + 1, s)
            if done.any():
                k = np.flatnonzero(done)
                witness = self.sa[np.where(other[k], at[k], np.minimum(self.differs[at[k]], len(self.sa) - 1))]
                more = self._follow(base[k] + s[k] + width, witness + width, last[k] - s[k])
                # A segment of several owners is shared as it stands.
                more = np.where(owner[k] == self.MANY, last[k] - s[k], more)
                out.append((seg[k], s[k], s[k] + more))
                nxt[k] = s[k] + more + 1
            again = restart | done
            s = np.where(again, nxt, s)
            j = np.where(again, s + width, j)
            lo, hi = np.where(again, 0, lo), np.where(again, len(self.text), hi)
            stay = s <= last
            if not stay.all():
                seg, owner, base, last, s, j, lo, hi = (x[stay] for x in (seg, owner, base, last, s, j, lo, hi))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def _follow(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` and ``b`` on agree, at most ``most``."""
        got, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        end = len(self.text) - 1
        while len(live):
            x, y = self.text[np.minimum(a[live] + got[live], end)], self.text[np.minimum(b[live] + got[live], end)]
            same = (x == y) & (x != 0)
            got[live[same]] += 1
            live = live[same & (got[live] < most[live])]
        return got
