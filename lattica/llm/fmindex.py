"""A compressed full-text index over word sequences, searched for many sequences at once with numpy."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit-packed wavelet tree, level by level, with counts each 64 bits: how often a symbol occurs before a place."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        n = len(values)
        self.n_levels = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for b in range(self.n_levels - 1, -1, -1):
            bit = (values >> b & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(n // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), dtype=np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int32, out=before[1:])
            ones = int(bit.sum())
            self.levels.append((words, before, n - ones))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.first = self._walk(np.arange(n_symbols), np.zeros(n_symbols, dtype=np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (words, before, zeros) in enumerate(self.levels):
            w = at >> 6
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> (self.n_levels - 1 - level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbols, at) - self.first[symbols]


def suffix_array(values: np.ndarray) -> np.ndarray:
    """By prefix doubling; values are small non-negative integers."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step if step < n else 0] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FmIndex:
    """Index over several sequences of symbols from 1; no match reaches over the end of a sequence."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, copies: np.ndarray | None = None):
        """symbols: all sequences one after another; copies: how often each one stands in what is indexed (once each if not given)."""
        n_seq, n_symbols = len(sizes), int(symbols.max(initial=0)) + 1
        ends = np.cumsum(sizes)
        self.starts = ends - sizes + np.arange(n_seq)
        self.ends = self.starts + sizes
        self.n = len(symbols) + n_seq
        self.text = np.zeros(self.n, dtype=np.int64)
        word = np.ones(self.n, dtype=bool)
        word[self.ends] = False
        self.text[word] = symbols
        apart = np.where(word, self.text + n_seq, 0)
        apart[self.ends] = np.arange(n_seq)
        order = suffix_array(apart)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=n_symbols))])
        self.ranks = WaveletMatrix(self.text[order - 1], n_symbols)
        owner = np.repeat(np.arange(n_seq), sizes + 1)
        self.weight = np.concatenate([[0], np.cumsum(copies[owner[order]])]) if copies is not None else np.arange(self.n + 1)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with the symbol and go on with what [lo, hi) start with."""
        m = len(symbols)
        at = self.ranks.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi])) + np.concatenate([self.less[symbols]] * 2)
        return at[:m], at[m:]

    def times(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How often what the suffixes [lo, hi) start with occurs, copies counted."""
        return self.weight[hi] - self.weight[lo]

    def _windows(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Whether each window occurs at least twice."""
        out = np.zeros(len(starts), dtype=bool)
        left = np.arange(len(starts))
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, dtype=np.int64)
        for k in range(width - 1, -1, -1):
            lo, hi = self.extend(self.text[starts[left] + k], lo, hi)
            ok = self.times(lo, hi) >= 2
            left, lo, hi = left[ok], lo[ok], hi[ok]
        out[left] = True
        return out

    def repeated(self, which: np.ndarray, width: int, steps: int = 160) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal intervals of sequences `which` in which every window of `width` symbols occurs at least twice in the index.

        Backward search keeps the longest match that ends at e and occurs twice. Where it breaks, at place p, a short
        unique sequence that starts at p is looked for: no repeated window holds it, so the search goes on from its end.
        Sequences that break again and again, such as loops of a few words, aren't waited for: after `steps` steps the
        windows they have left are searched all at once.
        Returns (position in which, first symbol, end) relative to the sequence's start.
        """
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        own = np.arange(len(which))
        first = self.starts[which]
        e = self.ends[which].copy()
        keep = e - first >= width
        own, first, e = own[keep], first[keep], e[keep]
        p, lo, hi = e.copy(), np.zeros(len(e), np.int64), np.full(len(e), self.n, dtype=np.int64)
        broke = np.full(len(e), -1, dtype=np.int64)  # the place p that broke the match while a unique sequence is looked for
        span = np.zeros(len(e), dtype=np.int64)
        for _ in range(steps):
            if not len(own):
                break
            nlo, nhi = self.extend(self.text[p - 1], lo, hi)
            ok = self.times(nlo, nhi) >= 2
            p = np.where(ok, p - 1, p)
            lo, hi = np.where(ok, nlo, lo), np.where(ok, nhi, hi)
            scan = broke < 0
            whole = scan & ok & (p == first)
            ended = scan & (~ok | whole)
            long = ended & (e - p >= width)
            if long.any():
                out.append((own[long], p[long] - first[long], e[long] - first[long]))
            # a match broke: look for a short unique sequence from the breaking place on
            fail = scan & ~ok
            broke[fail] = p[fail] - 1
            span[fail] = 2
            # a trial sequence occurs twice: try twice its length; is unique: go on before its end
            passed = ~scan & ok & (p == broke)
            span[passed] *= 2
            trial = fail | passed
            over = trial & (broke + span >= e)
            trial &= ~over
            unique = ~scan & ~ok
            e = np.where(over, e - 1, np.where(unique, broke + span - 1, e))
            back = over | unique
            broke[back] = -1
            p = np.where(back, e, np.where(trial, broke + span, p))
            new = back | trial
            lo[new], hi[new] = 0, self.n
            done = whole | (back & (e - first < width))
            if done.any():
                go = ~done
                own, first, e, p, lo, hi, broke, span = (x[go] for x in (own, first, e, p, lo, hi, broke, span))
        for at in range(0, len(own), 256):
            part = slice(at, at + 256)
            counts = e[part] - first[part] - width + 1
            of = np.repeat(np.arange(len(counts)), counts)
            start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = self._windows(first[part][of] + start, width)
            # runs of hits within a sequence
            fresh = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & (start > 0)))
            last = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & (np.concatenate([start[1:], [0]]) > 0)))
            out.append((own[part][of[fresh]], start[fresh], start[last] + width))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out))
