"""Runs: maximal stretches of words that repeat with a period, found through Lempel-Ziv blocks.

Every word of a run of ``least`` words or more stands in a window of half as many words that the document holds
twice. So windows met once cut a document into stretches, which keep all its runs whole and maximal. In each
stretch:

1. Ranks of all substrings of 1, 2, 4, ... words (prefix doubling) give the suffix array, the common prefixes of
   its neighbours, and the common extension of any two places, forward or backward, in log steps.
2. The longest previous factor of each place: places leave the suffix array from last to first, so a place's
   neighbours are then the nearest earlier ones. It cuts the stretch into Lempel-Ziv blocks.
3. A run that crosses or touches a block's border is found there: for each period that the blocks beside it
   allow, the extensions both ways from the border (Main) show it. All borders and periods are taken at once.
4. A run strictly inside a block is a copy of an earlier one: blocks are walked in order, and runs are copied
   from buckets by start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, mix64
from .shared import prepare


class Substrings:
    """Ranks of all substrings of lengths 1, 2, 4, ... of a sequence of numbers; shorter at its end."""

    def __init__(self, values: np.ndarray):
        n, size = len(values), 1
        self.n, self.levels = n, [np.unique(values, return_inverse=True)[1].reshape(-1)]
        while n and self.levels[-1].max() < n - 1:
            rank = self.levels[-1]
            behind = np.concatenate([rank[size:] + 1, np.zeros(min(size, n), rank.dtype)])
            self.levels.append(np.unique(rank * np.int64(n + 1) + behind, return_inverse=True)[1].reshape(-1))
            size *= 2

    def suffix_array(self) -> np.ndarray:
        return np.argsort(self.levels[-1])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from place a on equal those from place b on."""
        out, room = np.zeros(len(a), np.int64), self.n - np.maximum(a, b)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, last = self.levels[k], self.n - 1
            same = (out + (1 << k) <= room) & (rank[np.minimum(a + out, last)] == rank[np.minimum(b + out, last)])
            out += same.astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to place a, itself included, equal those up to place b."""
        out, room = np.zeros(len(a), np.int64), np.minimum(a, b) + 1
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], 1 << k
            same = (out + step <= room) & (rank[np.maximum(a - out - step + 1, 0)] == rank[np.maximum(b - out - step + 1, 0)])
            out += same.astype(np.int64) << k
        return out


def previous_factors(suffixes: np.ndarray, common: np.ndarray) -> tuple[list[int], list[int]]:
    """(length, source) of the longest factor from each place on that also starts earlier; common[r] is of the suffixes r - 1 and r."""
    n = len(suffixes)
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.arange(n)
    place, rank, low = suffixes.tolist(), rank.tolist(), common.tolist() + [0]
    up, down = list(range(-1, n - 1)), list(range(1, n + 1))
    length, source = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):  # the last place is left out of the list after it was asked, so only earlier ones remain
        r = rank[i]
        a, b = up[r], down[r]
        x, y = low[r], low[b]
        if x >= y:
            if x:
                length[i], source[i] = x, place[a]
        else:
            length[i], source[i] = y, place[b]
        if a >= 0:
            down[a] = b
        if b < n:
            up[b], low[b] = a, min(x, y)
    return length, source


def _border_runs(text: Substrings, blocks: np.ndarray, least: int) -> np.ndarray:
    """(start, length, period) of runs that cross or touch a block's border; blocks: starts, and the end."""
    size = np.diff(blocks)
    border, after = blocks[1:], np.append(size[1:], 0)

    def spread(most):
        return np.repeat(border, most), np.arange(int(most.sum())) - np.repeat(np.cumsum(most) - most, most) + 1

    b, p = spread(after)  # a whole period lies behind the border
    ahead, back = text.forward(b, b + p), text.backward(b - 1, b + p - 1)
    right = np.stack([b - back, back + p + ahead, p])
    b, p = spread(np.minimum(size + after - 1, border))  # a whole period lies before it
    ahead, back = text.forward(b - p, b), text.backward(b - p - 1, b - 1)
    left = np.stack([b - p - back, back + p + ahead, p])
    found = np.concatenate([right, left], axis=1)
    return found[:, found[1] >= np.maximum(least, 2 * found[2])]


def find_runs(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of max(least, 2 * period) numbers or more, by start, then period."""
    if len(values) < least:
        return []
    text = Substrings(values)
    suffixes = text.suffix_array()
    common = np.concatenate([[0], text.forward(suffixes[:-1], suffixes[1:])])
    length, source = previous_factors(suffixes, common)
    blocks, at = [], 0
    while at < len(values):
        blocks.append(at)
        at += max(1, length[at])
    best: dict[tuple[int, int], int] = {}
    for start, size, period in _border_runs(text, np.array([*blocks, len(values)]), least).T.tolist():
        if period < best.get((start, size), period + 1):
            best[start, size] = period
    by_start: dict[int, set] = {}
    for (start, size), period in best.items():
        by_start.setdefault(start, set()).add((size, period))
    for block in blocks:
        end, back = block + length[block], block - source[block]
        for start in range(block + 1, end - least):  # a copy's neighbours on both sides are in the block too
            for size, period in by_start.get(start - back, ()):
                if start + size < end:
                    by_start.setdefault(start, set()).add((size, period))
    return sorted(((s, n, p) for s, found in by_start.items() for n, p in found), key=lambda r: (r[0], r[2]))


def stretches(words: Words, least: int) -> list[tuple[int, int, int]]:
    """(text, from, to) of stretches of ``least`` words or more that windows of half as many, met twice in the text, cover."""
    half, n = (least + 1) // 2, len(words.hash)
    at = np.flatnonzero(words.full(half))
    if not len(at):
        return []
    key = mix64(words.grams(half)[at] ^ mix64(words.doc[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + half, -1)
    held = np.cumsum(edge[:-1]) > 0
    new = np.concatenate([[True], (held[1:] != held[:-1]) | (words.doc[1:] != words.doc[:-1])])
    low = np.flatnonzero(new)
    high = np.append(low[1:], n)
    keep = held[low] & (high - low >= least)
    return [(int(words.doc[a]), int(a), int(b)) for a, b in zip(low[keep], high[keep])]


def _numbers(words: Words, texts: list[int]) -> dict[int, np.ndarray]:
    """The words of each text as numbers, equal only for equal words."""
    split = pc.split_pattern(pa.array([words.plain(d) for d in texts], pa.binary()), " ")
    codes = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    edge = np.concatenate([[0], np.cumsum(np.diff(words.first)[texts])])
    return {d: codes[edge[i] : edge[i + 1]] for i, d in enumerate(texts)}


def _chunks(texts: list, most: int):
    """Ranges of texts of about ``most`` bytes."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= most:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _of_texts(texts: list, least: int) -> tuple[list, list, list]:
    """(number of words, runs, words kept, joined by one space) of each text."""
    words = Words(texts)
    runs: list[list] = [[] for _ in texts]
    found = stretches(words, least)
    numbers = _numbers(words, sorted({d for d, _, _ in found}))
    for d, low, high in found:
        first = int(words.first[d])
        runs[d] += [(s + low - first, n, p) for s, n, p in find_runs(numbers[d][low - first : high - first], least)]
    kept = []
    for d, own in enumerate(runs):
        plain = words.plain(d)
        if own:
            edge = np.zeros(int(words.first[d + 1] - words.first[d]) + 1, np.int64)
            for s, n, p in own:
                edge[s + p] += 1
                edge[s + n] -= 1
            split = plain.split(b" ")
            plain = b" ".join([split[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])
        kept.append(plain)
    return np.diff(words.first).tolist(), runs, kept


def _detect(least: int, most: int):
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for low, high in _chunks(texts, most):
                n, runs, kept = _of_texts(texts[low:high], least)
                listed = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(listed, _RUN), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 12, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_words, runs array<struct<start,length,period>>, collapsed_text.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text (null: none). A run is a stretch of words with smallest period q
    and at least max(least, 2 * q) words that no neighbouring word extends; runs come by start, then period.
    collapsed_text holds the words that no run contains after its first q words, joined by one space. Each text
    is judged on its own, so repeated rows have equal results, and null ids stay. Empty texts have no runs; an empty table
    gives an empty result. A text is in memory as a whole, with log(words) ranks for each word of a repetitive stretch.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(_detect(least, chunk_bytes), "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return found.select("doc_id", "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed_text"))
