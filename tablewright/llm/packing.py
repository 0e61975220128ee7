"""Packing documents into fixed windows by minimum bin slack.

1. Documents are tokenised once. Whole windows are cut off each; what remains (under one window) is
   the item to pack. Per document the checksums of the whole windows and the ids of the remainder
   are written to the shared folder.
2. The driver sees one number for each remainder length (1..capacity-1), whatever the corpus size. A
   bitset subset-sum dynamic programme over that multiset finds the fill closest to the capacity;
   backtracking gives how many items of each length it takes. The pattern is used as often as the
   counts allow, so each step uses up a length, and the plan stays short. A slack that no
   item fits is filled by cutting one; what is left at last is cut at powers of two.
3. Items are numbered within their length by prefix sums over map tasks, and each finds its place
   in the plan by binary search. No task gathers a length, no row goes to the driver.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, store, task_base

SPECIAL = "<|endoftext|>"
#: White space of this length goes to the library: the faster reader's matcher runs out of stack between 300,000 and 1,000,000.
_GAP = re.compile(r"\s{10000}")


@lru_cache(maxsize=2)
def _library(json_path: str):
    """Read when a text needs it: few do, and every worker would hold it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@lru_cache(maxsize=2)
def _tokenizer(json_path: str, ranks_path: str, pattern: str):
    """Ids of the JSON tokenizer, made by the faster reader of the same vocabulary.

    The two differ in that the first takes a special token's string in a text for the token, and
    reads white space of any length: such texts go to it.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text or (len(text) >= 10_000 and _GAP.search(text)):
            return _library(json_path).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_TOKENS = "part int, doc_id long, doc_tokens long, crcs array<long>, full_at long, rest int, rank long, ids binary"
_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("full_at", pa.int64()), ("rest", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])


def _tokenise(capacity: int, end_id: int, tokenizer: tuple):
    def run(batches):
        part, full, ranks = task_base() >> 33, 0, {}
        encode = _tokenizer(*tokenizer)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype=np.uint32)
                whole = len(ids) // capacity
                crcs = [_crc(ids[i * capacity : (i + 1) * capacity]) for i in range(whole)]
                rest = ids[whole * capacity :]
                rank = ranks.get(len(rest), 0)
                ranks[len(rest)] = rank + 1
                out.append((part, doc_id, len(ids), crcs, full, len(rest), rank, rest.astype("<u4").tobytes()))
                full += whole
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return run


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of item lengths whose sum is closest to, and at most, ``room``.

    A bitset holds the reachable sums after each length (an integer's bits; a length's count is
    taken in binary portions); backtracking through the bitsets gives the counts. Long items come
    first, so ties prefer them.
    """
    mask = (1 << (room + 1)) - 1
    portions = []
    for length in sorted((c for c in counts if 0 < c <= room and counts[c]), reverse=True):
        have, size = min(counts[length], room // length), 1
        while have:
            take = min(size, have)
            portions.append((length, take))
            have, size = have - take, size * 2
    reach = [1]
    for length, take in portions:
        new = reach[-1] | reach[-1] << length * take & mask
        reach.append(new)
        if new >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    fill: dict[int, int] = {}
    for i in range(len(reach) - 1, 0, -1):
        length, take = portions[i - 1]
        if not reach[i - 1] >> total & 1:
            fill[length] = fill.get(length, 0) + take
            total -= length * take
    return fill


class Plan:
    """Windows built over a histogram of item lengths.

    A slot takes ``take`` tokens of ``count`` items of one source, starting with item ``first`` of it;
    item first + i goes to window ``window`` + i at ``offset``. Sources are lengths (as -length: items
    by rank) or slots (what is left of the items that they cut). Every token of every item is in one
    slot.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.slots: list[tuple] = []
        self.of: dict[int, list[int]] = {}  # slots by source, in the order of their first items
        self.windows = 0
        self._queue = {c: [[-c, 0, n]] for c, n in histogram.items() if c > 0 and n > 0}
        left = lambda: {c: sum(q[2] for q in qs) for c, qs in self._queue.items()}
        counts = left()
        while sum(c * n for c, n in counts.items()) > capacity:
            self._fill(counts, capacity)
            counts = left()
        self._rest(capacity)

    def _fill(self, counts: dict[int, int], capacity: int) -> None:
        fill = best_fill(counts, capacity)
        slack = capacity - sum(c * n for c, n in fill.items())
        need = dict(fill)
        if slack:  # nothing fits: cut one more of the longest items
            cut = max(c for c in counts if counts[c] > fill.get(c, 0))
            need[cut] = need.get(cut, 0) + 1
        times, offset = min(counts[c] // n for c, n in need.items()), 0
        for c in sorted(fill, reverse=True):
            for _ in range(fill[c]):
                self._place(c, times, offset, c)
                offset += c
        if slack:
            self._place(cut, times, offset, slack)
        self.windows += times

    def _place(self, length: int, times: int, offset: int, take: int) -> None:
        window, queue = self.windows, self._queue[length]
        while times:
            source, first, have = queue[0]
            n = min(have, times)
            self.of.setdefault(source, []).append(len(self.slots))
            if take < length:
                self._queue.setdefault(length - take, []).append([len(self.slots), 0, n])
            self.slots.append((first, n, window, offset, take))
            queue[0][1], queue[0][2] = first + n, have - n
            if have == n:
                queue.pop(0)
            window, times = window + n, times - n
        if not queue:
            del self._queue[length]

    def _rest(self, capacity: int) -> None:
        """At most one window's tokens are left: sequences of powers of two, which need no padding."""
        left = sum(c * q[2] for c, qs in self._queue.items() for q in qs)
        offset, room = 0, 1 << left.bit_length() - 1 if left else 0
        if left == capacity:
            room = capacity
        while self._queue:
            length = max(self._queue)
            take = min(length, room - offset)
            self._place(length, 1, offset, take)
            offset, left = offset + take, left - take
            if offset == room:
                self.windows += 1
                offset, room = 0, 1 << left.bit_length() - 1 if left else 0

    def pieces(self, length: int, rank: int):
        """(tokens, window, offset) of the item's pieces, from its first token on."""
        source, item = -length, rank
        while source in self.of:
            slots = self.of[source]
            slot = slots[bisect_right(slots, item, key=lambda s: self.slots[s][0]) - 1]
            first, n, window, offset, take = self.slots[slot]
            item -= first
            if not 0 <= item < n:
                return
            yield take, window + item, offset
            source = slot


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def _deal(made: Plan, capacity: int):
    def run(batches):
        for b in batches:
            out = []
            for doc_id, n, crcs, full, rest, rank, raw in zip(*(b.column(i).to_pylist() for i in range(7))):
                out += [(doc_id, i * capacity, capacity, crc, n, made.windows + full + i, 0) for i, crc in enumerate(crcs)]
                at = 0
                for take, window, offset in made.pieces(rest, rank) if rest else ():
                    out.append((doc_id, len(crcs) * capacity + at, take, zlib.crc32(raw[4 * at : 4 * (at + take)]), n, window, offset))
                    at += take
                assert at == rest
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=_NAMES)

    return run


def pack(docs: DataFrame, tokenizer: tuple, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text (null: empty; others are ignored); a document is its ids and
    ``end_id``. ``tokenizer``: (path of the JSON file, path of the same vocabulary as ranks, pattern).
    Every id lies in one piece; pieces of a sequence are gapless from offset 0; sequences hold
    ``capacity`` ids, but for at most log2(capacity) at the end, which hold a power of two. Repeated
    rows are packed each on its own. An empty table gives an empty result. start counts the
    document's ids before the piece.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tokens = store(rows.mapInArrow(_tokenise(capacity, end_id, tokenizer), _TOKENS), "tokens")
    counts = tokens.groupBy("part", "rest").agg(F.count("*").alias("n"))
    full = tokens.groupBy("part").agg(F.sum(F.size("crcs")).cast("long").alias("n")).select("part", F.lit(-1).alias("rest"), "n")
    before = F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = store(counts.union(full).withColumn("base", F.coalesce(before, F.lit(0)).cast("long")), "counts")
    histogram = {r[0]: r[1] for r in base.where("rest > 0").groupBy("rest").agg(F.sum("n")).collect()}  # under ``capacity`` rows
    made = Plan(histogram, capacity)
    ranks = base.select("part", "rest", F.col("base").alias("rank_base"))
    fulls = base.where("rest = -1").select("part", F.col("base").alias("full_base"))
    placed = tokens.join(ranks.join(fulls, "part"), ["part", "rest"])
    return placed.select("doc_id", "doc_tokens", "crcs", F.col("full_at") + F.col("full_base"), "rest", F.col("rank") + F.col("rank_base"), "ids").mapInArrow(_deal(made, capacity), _PIECES)
