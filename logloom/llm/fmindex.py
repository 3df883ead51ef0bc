"""A compressed FM-index over a sequence of numbers, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

from logloom.llm.textkit import U64, gram_hashes, mix


class Bits:
    """Packed bits with rank: counts by 16 bits within blocks of 2**16 bits, and by 32 bits between these."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        self.words = np.zeros(n // 64 + 1, U64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.blocks = before[:-1:1024].astype(np.uint32)
        self.inner = (before[:-1] - np.repeat(self.blocks.astype(np.int64), 1024)[: len(before) - 1]).astype(np.uint16)
        self.ones = int(before[-1])
        self.zeros = n - self.ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = self.words[w] & ((U64(1) << (i & 63).astype(U64)) - U64(1))
        return self.blocks[w >> 10].astype(np.int64) + self.inner[w] + np.bitwise_count(low)

    def nbytes(self) -> int:
        return self.words.nbytes + self.blocks.nbytes + self.inner.nbytes


class WaveletTree:
    """A sequence by the bits of its numbers' codes, level by level; frequent numbers have short codes.

    A number that makes up the share p has a code of about -log2(p) bits, so the levels take
    the sequence's entropy and not its width. Each level has its zeros before its ones, and
    codes are given out so that what ends at a level lies at its front, where it is left out of the next.
    """

    def __init__(self, x: np.ndarray, sigma: int):
        freq = np.bincount(x, minlength=sigma)
        length = np.maximum(1, np.ceil(np.log2(len(x) / np.maximum(freq, 1)) - 1e-9)).astype(np.int64)
        length[freq == 0] = 0
        self.length = length.astype(np.uint8)
        self.code = np.zeros(sigma, U64)
        order = np.lexsort((-freq, length))
        order = order[length[order] > 0]
        ends = np.bincount(length[order], minlength=2)
        nodes, given = np.zeros(1, U64), 0
        self.levels: list[Bits] = []
        self.done = []  # entries that end at each level
        codes = None
        for level in range(len(ends) - 1):
            nodes = np.concatenate((nodes, nodes | U64(1 << level)))
            n = int(ends[level + 1])
            self.code[order[given : given + n]] = nodes[:n]
            given += n
            nodes = nodes[n : n + len(order) - given]
            self.done.append(int(freq[order[given - n : given]].sum()))
        codes = self.code[x]
        for level, done in enumerate(self.done):
            bit = (codes >> U64(level)) & U64(1) > 0
            self.levels.append(Bits(bit))
            codes = np.concatenate((codes[~bit], codes[bit]))[done:]
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        i, length, code = i.copy(), self.length[c], self.code[c]
        live = np.flatnonzero(length)
        for level, bits in enumerate(self.levels):
            at = i[live]
            ones = bits.rank(at)
            i[live] = np.where((code[live] >> U64(level)) & U64(1) > 0, bits.zeros + ones, at - ones)
            live = live[length[live] > level + 1]
            if not len(live):
                break
            i[live] -= self.done[level]
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c is among the first i entries."""
        return np.where(self.length[c] > 0, self._down(c, i) - self.base[c], 0)

    def nbytes(self) -> int:
        return sum(b.nbytes() for b in self.levels) + self.length.nbytes + self.code.nbytes + self.base.nbytes


class FMIndex:
    """Backward search for patterns of up to `reach` numbers; the number 0 ends a text and matches nothing.

    Suffixes are sorted by their first `reach` numbers, and by place where these are equal.
    That is enough for such patterns. Of the suffix array only the first suffix of each such
    group is kept, the earliest place of its pattern; the text itself isn't kept. A table of all
    runs of `seed` numbers (by 64-bit hashes) has their intervals, so that a search for whole patterns begins there.
    """

    def __init__(self, text: np.ndarray, reach: int):
        text = text.astype(np.int64)
        n = len(text)
        self.n, self.reach = n, reach
        self.sigma = int(text.max(initial=0)) + 1
        self.seed = 1 << max(0, (reach - 1).bit_length() - 1)
        rank, width, runs = text, 1, text
        while width < reach:
            if width == self.seed:
                runs = rank
            step = min(width, reach - width)
            after = np.concatenate((rank[step:], np.full(min(step, n), -1)))[:n]
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
            width += step
        suffixes = np.argsort(rank, kind="stable")
        ranked = rank[suffixes]
        head = np.concatenate(([True], ranked[1:] != ranked[:-1]))[:n]
        self.heads, self.places = Bits(head), suffixes[head].astype(np.int32)
        self.tree = WaveletTree(text[suffixes - 1], self.sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma)))).astype(np.int32)
        h, at = self._runs(text)
        own, once = np.unique(h[at], return_index=True)
        edge = np.concatenate(([0], np.cumsum(np.bincount(runs, minlength=1))))
        runs = runs[at[once]]
        self.keys, self.lo, self.hi = own, edge[runs].astype(np.int32), edge[runs + 1].astype(np.int32)

    def _runs(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `seed` numbers, and where those begin that don't contain the number 0."""
        zeros = np.concatenate(([0], np.cumsum(text == 0)))
        return gram_hashes(mix(text.astype(U64)), self.seed), np.flatnonzero(zeros[self.seed :] == zeros[: max(0, len(zeros) - self.seed)])

    def matches(self, text: np.ndarray, ends: np.ndarray, others: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text: how many numbers before each of the ends occur in the indexed text.

        Going back from each end, a pattern is extended while it occurs more than `others`
        times, up to reach. Returns the lengths and the last suffix intervals [lo, hi).
        """
        reached = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        self._extend(text, ends, reached, lo, hi, np.arange(len(ends)), 1, others)
        return reached, lo, hi

    def _extend(self, text: np.ndarray, ends: np.ndarray, reached: np.ndarray, lo_all: np.ndarray, hi_all: np.ndarray, live: np.ndarray, begin: int, others: int) -> None:
        """Takes the live patterns, which have begin - 1 numbers, back to up to reach."""
        for k in range(begin, self.reach + 1):
            if not len(live):
                break
            c = text[ends[live] - k]
            c = np.where(c < self.sigma, c, 0)
            both = self.tree.rank(np.concatenate((c, c)), np.concatenate((lo_all[live], hi_all[live])))
            lo, hi = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            more = (hi - lo > others) & (c > 0)
            live = live[more]
            lo_all[live], hi_all[live], reached[live] = lo[more], hi[more], k

    def whole(self, text: np.ndarray, ends: np.ndarray, others: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ends have `reach` numbers before them that occur more than `others` times, and where the intervals of these begin.

        The last `seed` of them are looked up, and the search goes back from there.
        """
        reached = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        if len(ends) and len(self.keys):
            h, at = self._runs(np.where(text < self.sigma, text, 0))
            known = np.zeros(len(h), bool)
            known[at] = True
            begin = ends - self.seed
            live = np.flatnonzero(known[begin])
            q = h[begin[live]]
            i = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
            ok = (self.keys[i] == q) & (self.hi[i] - self.lo[i] > others)
            live, i = live[ok], i[ok]
            lo[live], hi[live], reached[live] = self.lo[i], self.hi[i], self.seed
            self._extend(text, ends, reached, lo, hi, live, self.seed + 1, others)
        full = np.flatnonzero(reached == self.reach)
        return full, lo[full]

    def earliest(self, lo: np.ndarray) -> np.ndarray:
        """Smallest text position of the patterns of full reach whose intervals begin at lo."""
        return self.places[self.heads.rank(lo)].astype(np.int64)

    def nbytes(self) -> int:
        return self.tree.nbytes() + self.heads.nbytes() + self.places.nbytes + self.first.nbytes + self.keys.nbytes + self.lo.nbytes + self.hi.nbytes
