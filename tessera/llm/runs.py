"""Periodic runs of words: suffix array and LCP give the longest-previous-factor array, its LZ blocks give the boundaries at
which runs are extended both ways, and runs inside a block are copied from its earlier occurrence."""

from __future__ import annotations

from bisect import bisect_right, insort
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A run has at least so many words, and at least so many times its period.
MIN_LENGTH, MIN_EXPONENT = 6, 4
RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
ARROW_RUN = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (bytes other than 0x20 and 0x09 to 0x0D) of all texts, and where each text's words begin; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = (int(at[0]), int(at[-1])) if len(at) else (0, 0)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.empty(0, np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1] - lo
    edge = edge[edge < hi - lo]
    first[edge] = inside[edge]  # a text's first byte never goes on a word of the text before
    starts = np.flatnonzero(first)
    kept = np.cumsum(inside)
    places = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return words, np.searchsorted(starts, at - lo).astype(np.int64)


class Suffixes:
    """Suffixes of several word sequences, ranked by their first 1, 2, 4, ... words until all differ.

    levels[k][i] is equal for two places exactly if the 2^k words from there are; sequences never share a rank. Places in
    unique groups are left out of later sorts.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, least: int):
        n = len(ids)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.argsort(owner * (int(ids.max()) + 1) + ids.astype(np.int64), kind="stable")
        rank, active = self._grouped(np.zeros(n, np.int64), order, (owner[order], ids[order]))
        self.levels, self.end, width = [rank], bounds[1:][owner] if n else bounds[:0], 1
        self.begin = bounds[:-1][owner]
        self.keep = None
        while len(active):
            after = active + width
            second = np.where(after < self.end[active], rank[np.minimum(after, n - 1)], -1)
            order = np.argsort(rank[active] * (n + 1) + second + 1, kind="stable")
            where = active[order]
            new, rest = self._grouped(rank[where], np.arange(len(where)), (rank[where], second[order]))
            rank = rank.copy()
            rank[where] = new
            width, active = 2 * width, np.sort(where[rest])
            self.levels.append(rank)
            if width == least:
                # the others have no equal words as far apart as a run needs
                some = np.zeros(len(bounds) - 1, bool)
                some[owner[active]] = True
                self.keep = some
                if not some.all():
                    return
        if self.keep is None:
            self.keep = np.zeros(len(bounds) - 1, bool)

    @staticmethod
    def _grouped(base: np.ndarray, order: np.ndarray, keys: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of sorted rows: the place of a group's first row, counted behind the rank that its larger group had; and the
        rows whose groups have others."""
        n = len(order)
        if not n:
            return base, order
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        wide = np.ones(n, bool)
        wide[1:] = base[1:] != base[:-1]
        since = np.maximum.accumulate(np.where(wide, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = base + at[group] - since
        return rank, order[np.diff(np.append(at, n))[group] > 1]

    def padded(self) -> None:
        self.padded_levels = [np.append(x, -1) for x in self.levels]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i != j, same sequence)."""
        got, n = np.zeros(len(i), np.int64), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.padded_levels[k]
            got += (level[np.minimum(i + got, n)] == level[np.minimum(j + got, n)]).astype(np.int64) << k
        return got

    def behind(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words up to and with i equal those up to j (i < j, same sequence from begin)."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - got - (1 << k) + 1, j - got - (1 << k) + 1
            fits = a >= begin
            same = fits & (self.levels[k][np.where(fits, a, 0)] == self.levels[k][np.where(fits, b, 0)])
            got += same.astype(np.int64) << k
        return got


def previous_factors(suffixes: Suffixes) -> tuple[list[int], list[int]]:
    """For each place the length of the longest factor that also starts before it, and where; by suffix array and LCP.

    Places leave the suffix array from the last to the first, so both neighbours of a leaving one are earlier places.
    """
    final = suffixes.levels[-1]
    n = len(final)
    sa = np.argsort(final, kind="stable")
    lcp = np.zeros(n + 1, np.int64)
    same = suffixes.begin[sa[1:]] == suffixes.begin[sa[:-1]]
    lcp[1:n][same] = suffixes.ahead(sa[:-1][same], sa[1:][same])
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    common_, sa_, before, after = lcp.tolist(), sa.tolist(), list(range(-1, n)), list(range(1, n + 2))
    longest, source = [0] * n, [0] * n
    for i, r in zip(range(n - 1, -1, -1), rank[::-1].tolist(), strict=True):
        p, q = before[r], after[r]
        a, b = common_[r], common_[q]
        if a >= b:
            longest[i], common_[q] = a, b
            source[i] = sa_[p]
        else:
            longest[i], source[i] = b, sa_[q]
            common_[q] = a
        if p >= 0:
            after[p] = q
        before[q] = p
    return longest, source


def lz_blocks(longest: list[int], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of the LZ blocks of all sequences: each the longest previous factor, or one new word."""
    begins = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        while lo < hi:
            begins.append(lo)
            lo += longest[lo] or 1
    begin = np.array(begins, np.int64)
    return begin, np.diff(np.append(begin, bounds[-1]))


def boundary_runs(s: Suffixes, begin: np.ndarray, length: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs that meet a block's boundary, or end at one.

    A run ending in a block or at its end starts less than a period before the block before (else that one would be longer), so
    (min_exponent - 1) periods are shorter than both blocks together. From each boundary b and such a period p the pairs
    (b - 1 - p, b - 1) and (b, b + p) are extended both ways; one of them lies in any such run.
    """
    n = len(s.levels[0])
    last = np.append(s.begin[begin[1:]] != s.begin[begin[:-1]], True)  # the last block of a sequence
    b = np.concatenate([begin, (begin + length)[last]])
    first = begin == s.begin[begin]
    before = np.concatenate([np.where(first, 0, np.append(0, length[:-1])), length[last]])
    after = np.concatenate([length, np.zeros(int(last.sum()), np.int64)])
    low = np.concatenate([s.begin[begin], s.begin[begin[last]]])
    high = np.concatenate([s.end[begin], s.end[begin[last]]])
    most = np.maximum(0, (before + after - 1) // (min_exponent - 1))
    row = np.repeat(np.arange(len(b)), most)
    p = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most) + 1
    word = s.levels[0]
    found = []
    for x in (b[row] - 1 - p, b[row]):
        fits = (x >= low[row]) & (x + p < high[row])
        i, q, lo = x[fits], p[fits], low[row][fits]
        equal = word[i] == word[i + q]
        i, q, lo = i[equal], q[equal], lo[equal]
        end = i + q + s.ahead(i, i + q)
        start = i - s.behind(i - 1, i + q - 1, lo)
        long = end - start >= np.maximum(min_length, min_exponent * q)
        found.append((start[long], end[long], q[long]))
    start, end, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], q[new]  # of equal places the least period


def copied_runs(runs: list[tuple[int, int, int]], begin: list[int], length: list[int], source: list[int], min_length: int) -> list[tuple[int, int, int]]:
    """runs (sorted by start) with those strictly inside blocks, which are copies of runs inside the block's earlier occurrence."""
    known = list(runs)
    have = {(s, e) for s, e, _ in known}
    for b, size in zip(begin, length, strict=True):
        if size < min_length + 2:
            continue
        src, shift = source[b], b - source[b]
        at = bisect_right(known, (src, 1 << 62, 0))
        while at < len(known) and known[at][0] < src + size:
            s, e, q = known[at]
            # a copy starts after its source, so it is met later when the block overlaps its own source
            if e < src + size and (s + shift, e + shift) not in have:
                have.add((s + shift, e + shift))
                insort(known, (s + shift, e + shift, q))
            at += 1
    return known


def runs_of(ids: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> dict[int, list[tuple[int, int, int]]]:
    """sequence -> (start, length, period) of all its runs, by start and period, for sequences of word numbers parted at bounds."""
    if len(ids) == 0:
        return {}
    # a run of period q repeats its first words q later: at least so many of them
    apart = min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))
    least = 1 << (apart.bit_length() - 1)
    s, some = Suffixes(ids, bounds, least), np.arange(len(bounds) - 1)
    while s.keep is not None and not s.keep.all():
        if not s.keep.any():
            return {}
        sizes, owners = np.diff(bounds), s.keep
        ids, some = ids[np.repeat(owners, sizes)], some[owners]
        bounds = np.append(0, np.cumsum(sizes[owners]))
        s = Suffixes(ids, bounds, least)
    s.padded()
    longest, source = previous_factors(s)
    begin, length = lz_blocks(longest, bounds)
    start, end, period = boundary_runs(s, begin, length, min_length, min_exponent)
    out: dict[int, list[tuple[int, int, int]]] = {}
    owner = np.searchsorted(bounds, start, "right") - 1
    cuts, blocks = np.searchsorted(start, bounds), np.searchsorted(begin, bounds)
    for k in np.unique(owner).tolist():
        mine, own = slice(cuts[k], cuts[k + 1]), slice(blocks[k], blocks[k + 1])
        all_runs = copied_runs(list(zip(start[mine].tolist(), end[mine].tolist(), period[mine].tolist(), strict=True)), begin[own].tolist(), length[own].tolist(), source, min_length)
        lo = int(bounds[k])
        out[int(some[k])] = sorted((a - lo, e - a, q) for a, e, q in all_runs)
        out[int(some[k])].sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equal ones the first start, then the least period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with n_words, runs, strongest_run and collapsed.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0. A run is a stretch with smallest period q and at least
    max(min_length, min_exponent * q) words which no neighbouring word extends; min_exponent is 3 or more. runs holds (start,
    length, period) by start, then period; strongest_run is the one of greatest length / period (of equal ones the first start,
    then the least period), null without runs; collapsed is the text's words without those that a run repeats after its first
    period, joined by one space. A null or empty text has no words, no runs and an empty collapsed; repeated rows are treated
    each for itself; an empty table gives an empty table. Input columns of the new names are replaced.

    Documents are independent, so nothing is shuffled; the documents of an Arrow batch are sorted together, each under its own ranks.
    """
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("strongest_run", RUN.elementType), T.StructField("collapsed", T.StringType())]

    def make():
        def compute(texts: pa.Array):
            words, bounds = split_words(texts)
            ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            found = runs_of(ids, bounds, min_length, min_exponent)
            keep = np.ones(len(ids), bool)
            for k, runs in found.items():
                for start, size, q in runs:
                    keep[bounds[k] + start + q : bounds[k] + start + size] = False
            kept = np.append(0, np.cumsum(keep))[bounds]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep))), pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
            as_row = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
            every = [found.get(k, []) for k in range(len(bounds) - 1)]
            return [pa.array(np.diff(bounds)), pa.array([[as_row(r) for r in runs] for runs in every], ARROW_RUN), pa.array([as_row(strongest(runs)) for runs in every], ARROW_RUN.value_type), joined]

        return compute

    return common.arrow_columns(docs, [text], fields, make)


def replayed(words: Column, start: Column, period: Column, times: Column) -> Column:
    """A text of the words, but from number start on the next period words again and again, at most so many times and as far as
    there were words."""
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, start + 1, period), times)), F.lit(1), F.size(words) - start)
    return F.array_join(F.concat(F.slice(words, F.lit(1), start), tail), " ")
