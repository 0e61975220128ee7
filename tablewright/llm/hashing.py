"""Vectorised word and word-window hashes over a batch of texts.

All texts of a batch are laid out in one byte buffer. A word's hash is a sum over its 8-byte blocks, each
put through a bit mixer together with its place; a window's hash mixes the hashes of its halves, tree-wise.
Neither is a polynomial: sums of powers modulo 2**64 have collisions that do not depend on the base (words
that swap two letters in the Thue-Morse order). No Python loop touches a word. Hashes find candidates;
operators compare words, or a cryptographic digest of them, before they decide.
"""

from __future__ import annotations

import hashlib

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.uint64(0), np.uint64(0xD6E8FEB86659FD93))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective bit mixer on uint64 (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_hash(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``raw[start:end]`` for many ranges at once."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = raw + bytes(8)
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    size = end - start
    blocks = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(blocks) - blocks
    at = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    left = np.minimum(np.repeat(size, blocks) - 8 * at, 8).astype(np.uint64)
    value = eight[np.repeat(start, blocks) + 8 * at]
    value = value & (~np.uint64(0) >> ((np.uint64(8) - left) << np.uint64(3)))
    mixed = mix64(value ^ mix64((at.astype(np.uint64) + np.uint64(1)) * _STEP))
    return mix64(np.add.reduceat(mixed, first) + size.astype(np.uint64) * _STEP)


def window_hash(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Order-sensitive hash of the k values from each place on; places past the end count as 0."""
    whole = mix64(np.concatenate([values, np.zeros(k, np.uint64)]) ^ _SEEDS[seed])
    out, have, power = None, 0, 1
    while True:  # whole[i] covers ``power`` values, out[i] the first ``have``
        if k & power:
            part = whole[have:]
            out = part if out is None else mix64(out[: len(part)] * _STEP + part)
            have += power
        power *= 2
        if power > k:
            return out[: len(values)]
        whole = mix64(whole[: -(power // 2)] * _STEP + whole[power // 2 :])


def digest64(body: bytes) -> tuple[int, int]:
    """A cryptographic digest of 128 bits, as two signed 64-bit numbers."""
    raw = hashlib.blake2b(body, digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts (None: no words).

    ``doc[i]``, ``start[i]``, ``end[i]`` place word i; ``first[d]:first[d + 1]``
    are the words of text d; ``hash`` has one uint64 a word.
    """

    def __init__(self, texts: list, lower: bool = False):
        raw = [b"" if t is None else (t if isinstance(t, bytes) else t.encode()) for t in texts]
        self.n_texts = len(raw)
        self.bytes = b"\n".join(raw) + b"\n"
        buf = np.frombuffer(self.bytes, dtype=np.uint8)
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
            self.bytes = buf.tobytes()
        inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edges[0::2], edges[1::2]
        sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        self.limit = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.limit)
        self.doc = np.repeat(np.arange(self.n_texts), np.diff(self.first))
        self.hash = byte_hash(self.bytes, self.start, self.end)

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; windows past a text's end hold what follows (see ``full``)."""
        return window_hash(self.hash, k, seed)

    def full(self, k: int) -> np.ndarray:
        """Whether k words from each word on lie in its text."""
        return np.arange(len(self.hash)) + k <= self.first[self.doc + 1]

    def text(self, d: int) -> bytes:
        return self.bytes[self.limit[d] : self.limit[d + 1] - 1]

    def plain(self, d: int) -> bytes:
        """The words of text d joined by one space."""
        return b" ".join(self.text(d).split())


def sliding_minimum(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the rightmost minimum of the ``width`` values from each place on, whether they all lie in its sequence).

    ``first`` bounds independent sequences. Windows double in width, so log2(width) passes do.
    """
    n = len(values)
    last = np.repeat(first[1:], np.diff(first)) - 1
    best, have = np.arange(n), 1
    while have < width:
        step = min(have, width - have)
        other = best[np.minimum(np.arange(n) + step, last)]
        best = np.where(values[other] <= values[best], other, best)
        have += step
    return best, np.arange(n) + width - 1 <= last


def window_minima(values: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Winnowing: places such that every ``width`` consecutive values hold one with their minimum.

    Equal minima close together (text that repeats itself) are thinned to one in ``width``, so a
    window has a place with its minimal value, though not the same one in every copy.
    """
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    best, inside = sliding_minimum(values, first, width)
    at = np.unique(best[inside])
    return thinned(at, values[at], np.searchsorted(first, at, side="right"), width)


def thinned(at: np.ndarray, values: np.ndarray, seq: np.ndarray, width: int) -> np.ndarray:
    """Places without those that stand close between places of the same value and sequence: one in ``width`` stays."""
    tied = (values[1:] == values[:-1]) & (np.diff(at) < width) & (seq[1:] == seq[:-1])
    keep = np.ones(len(at), dtype=bool)
    inner = np.flatnonzero(tied[1:] & tied[:-1]) + 1  # neither first nor last of a run of equal minima
    last = -1
    for i in inner.tolist():
        if last != i - 1:
            held = at[i - 1]  # a run's first place is kept
        if at[i + 1] - held <= width:
            keep[i] = False
        else:
            held = at[i]
        last = i
    return at[keep]


def byte_minima(raw: bytes, first: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of winnowed k-byte strings (k >= 8): every ``least`` bytes of one of the texts ``first`` bounds hold a place with their smallest key.

    A key is a hash without its last 12 bits, which hold the place in blocks of 4,096 while minima are sought. Of
    equal keys in a window the last is taken, so copies of a window have places with the same key, and these differ
    even if the copies overlap.
    """
    n, width = len(raw), least - k + 1
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = mix64(np.ndarray((n + 1,), "<u8", raw + bytes(8), strides=(1,))[:n])
    size = 8
    while size < k:
        step = min(size, k - size)  # the last step overlaps
        hashed = mix64(hashed[:-step] * _STEP + hashed[step:])
        size += step
    low, block = np.uint64(0xFFF), 4096
    fresh = block - width + 1  # windows of a block, which overlaps the next one
    blocks = -(-len(hashed) // fresh)
    padded = np.concatenate([hashed, np.full(blocks * fresh + block - len(hashed), ~low)])
    coded = np.lib.stride_tricks.as_strided(padded, (blocks, block), (8 * fresh, 8))
    coded = (coded & ~low) | np.arange(block - 1, -1, -1, dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        coded = np.minimum(coded[:, :-step], coded[:, step:])
        have += step
    coded = coded.reshape(-1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first[:-1], 1)
    np.add.at(edge, np.maximum(first[:-1], first[1:] - least + 1), -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    place = np.unique(at // fresh * fresh + block - 1 - (coded[at] & low).astype(np.int64))
    key = hashed[place] & ~low
    kept = thinned(place, key, np.searchsorted(first, place, side="right"), width)
    return kept, hashed[kept] & ~low
