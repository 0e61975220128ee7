"""Suffix-array deduplication: every byte of a window of ``least`` bytes that also starts at an earlier place goes.

1. Anchors. Winnowing over k-byte strings selects a place in every window, the same one in all its copies. Only
   anchors are shuffled; one that is met twice is led by its first place.
2. Segments. Around each contested anchor lies all that windows with this anchor can cover. A text's stretches
   with the same leader are merged and go to that leader's shard. Before that, each map batch sorts its own
   segments (step 3): windows that start earlier in the batch are settled, and each distinct window goes on once.
3. Suffix arrays. Segments are sorted in two stages: suffixes smaller than their successor are sorted directly,
   the others are induced by one scan over the buckets of first bytes. Neighbours with a common prefix of
   ``least`` bytes are copies; all but the earliest of them are settled. What is sorted at once has a bound.
4. Shards over the bound are sorted in salted parts, from each of which every distinct window goes on once,
   until they fit. A shard that stays over it holds different windows round one common string; what is left of it goes through
   steps 1 to 3 again with longer anchors (``ks``), at last with anchors as long as the windows, so that
   unlike windows part.

That other copies than those of a shard meet in a sort does no harm: a window with an earlier copy is settled
rightly wherever it is seen, and the earliest copy of all is never settled, so all others of its shard meet it.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import byte_minima
from .shared import drop_table, prepare, store, task_base, with_uid

_LAST = (1 << 63) - 1


def _words_at(padded: bytes, n: int) -> np.ndarray:
    """The 8 bytes from each place on as numbers that sort like them."""
    return np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)


def _sorted_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places by the ``depth`` bytes there or more, 8 bytes a round, then by place; only ties that part are sorted again."""
    key = words[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(at)]  # apart from the place before
    now = 8
    while True:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        place, group = at[tied], np.cumsum(new[tied]) - 1
        if now >= depth or not len(tied):
            break
        key = words[place + now]
        parts = np.zeros(group[-1] + 1, bool)
        parts[group[1:][(key[1:] != key[:-1]) & (group[1:] == group[:-1])]] = True
        parts = parts[group]
        if parts.any():
            tied, place, group, key = tied[parts], place[parts], group[parts], key[parts]
            order = np.argsort(key)
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], key[order[1:]] != key[order[:-1]]]))
            joint = group * np.int64(len(key)) + rank
            order = np.argsort(joint)
            joint = joint[order]
            at[tied] = place[order]
            new[tied] = np.concatenate([[True], joint[1:] != joint[:-1]])
        now += 8
    at[tied] = np.sort(group * np.int64(len(words)) + place) % len(words)  # copies in the order of the text
    return at


def suffix_array(raw: bytes, depth: int) -> np.ndarray:
    """All suffixes of ``raw``, by their first ``depth`` bytes at least.

    Those that are smaller than their successor are sorted directly. The others are induced, bucket by bucket of
    first bytes: once a bucket is whole, the places before its suffixes that hold a larger byte are the next ones of
    their buckets; those that hold the same byte follow in the bucket itself, by how often it is repeated.
    """
    text, n = np.frombuffer(raw, np.uint8), len(raw)
    if n < 2:
        return np.arange(n)
    differs = np.flatnonzero(text[1:] != text[:-1])
    run = np.concatenate([[0], differs + 1])  # starts of runs of one byte
    rising = np.concatenate([text[differs] < text[differs + 1], [False]])  # a run's suffixes are smaller than their successors, as the next byte is larger
    length = np.diff(np.append(run, n))
    start, smaller = np.repeat(run, length), np.repeat(rising, length)
    direct = np.flatnonzero(smaller)
    direct = _sorted_directly(_words_at(raw + bytes(depth + 16), n + depth + 8), direct, depth)
    edge = np.searchsorted(text[direct], np.arange(257))  # they are sorted by first byte too
    waiting: list[list] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    whole = []
    for c in range(256):
        induced = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        if len(induced):
            times = induced - start[induced] + 1
            if times.max() > 1:
                back = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                order = np.argsort(back, kind="stable")
                induced = (np.repeat(induced, times) - back)[order]
        bucket = np.concatenate([induced, direct[edge[c] : edge[c + 1]]])
        if not len(bucket):
            continue
        whole.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        byte, before = byte[order], before[order]
        cut = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for part in np.split(before, cut) if len(before) else ():
            waiting[text[part[0]]].append(part)
    return np.concatenate(whole)


def common_prefixes(raw: bytes, suffixes: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, ``most`` at most (0 for the first); suffixes end with ``raw``.

    Where a suffix and the one before it are both followed in the text by such a pair, that pair shares one byte less, so
    only pairs that none follows are compared as a whole.
    """
    text, n = np.frombuffer(raw, np.uint8), len(raw)
    if len(suffixes) < 2:
        return np.zeros(len(suffixes), np.int64)
    before = np.full(n + 1, -2)
    before[suffixes[1:]] = suffixes[:-1]
    b = np.flatnonzero(before >= 0)
    a = before[b]
    last = before[b + 1] != a + 1
    stop = np.where(last | (text[a] != text[b]), b, n)  # the next place where it is known how long a pair is equal
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    ends = np.zeros(n + 1, np.int64)
    ends[b] = b
    a, b = a[last], b[last]
    words = _words_at(raw + bytes(most + 16), n + most + 8)
    room, alive, now = np.minimum(n - np.maximum(a, b), most), np.arange(len(b)), 0
    equal = room.copy()
    while len(alive) and now < most:
        apart = words[a[alive] + now] ^ words[b[alive] + now]
        stops = np.flatnonzero(apart)
        left = apart[stops]
        zeros = np.zeros(len(stops), np.int64)
        for byte in (4, 2, 1):  # leading bytes that are zero
            zero = left < np.uint64(1) << np.uint64(8 * (8 - byte))
            zeros += byte * zero
            left = np.where(zero, left << np.uint64(8 * byte), left)
        equal[alive[stops]] = np.minimum(now + zeros, room[alive[stops]])
        alive, now = alive[apart == 0], now + 8
    ends[b] += equal
    out = np.zeros(len(suffixes), np.int64)
    shared = np.zeros(n, np.int64)
    b = np.flatnonzero(before >= 0)
    shared[b] = np.minimum(ends[stop] - b, most)
    out[1:] = shared[suffixes[1:]]
    return out


def settle(segments: list, least: int) -> tuple[list, list]:
    """(spans, candidates) of segments (leader, part, doc, uid, start, text) sorted together.

    Spans (uid, from, to): bytes of windows that start at an earlier place too, of these segments. Candidates: segments of all other windows.
    """
    raw = b"".join(s[5] for s in segments)
    size = np.array([len(s[5]) for s in segments])
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(segments)), size)
    suffixes = suffix_array(raw, least)
    suffixes = suffixes[suffixes + least <= first[owner[suffixes] + 1]]
    if not len(suffixes):
        return [], []
    new = common_prefixes(raw, suffixes, least) < least
    rank = {t: i for i, t in enumerate(sorted({s[2:4] for s in segments}))}
    begin = np.array([(rank[s[2:4]] << 40) + s[4] for s in segments])
    place = (begin - first[:-1])[owner[suffixes]] + suffixes
    earliest = np.minimum.reduceat(place, np.flatnonzero(new))[np.cumsum(new) - 1]
    state = np.zeros(len(raw), np.int8)
    state[suffixes] = 1 + (place > earliest)

    def stretches(kind: int, gap: int) -> list[tuple[int, int, int]]:
        at = np.flatnonzero(state == kind)
        cut = np.flatnonzero((np.diff(at) > gap) | (owner[at[1:]] != owner[at[:-1]])) + 1
        ends = zip(at[np.concatenate([[0], cut])].tolist(), at[np.append(cut - 1, len(at) - 1)].tolist()) if len(at) else ()
        return [(int(owner[a]), a, b + least) for a, b in ends]

    spans = [(segments[i][3], segments[i][4] + a - int(first[i]), segments[i][4] + b - int(first[i])) for i, a, b in stretches(2, least)]
    return spans, [(*segments[i][:4], segments[i][4] + a - int(first[i]), raw[a:b]) for i, a, b in stretches(1, 1)]


_PART = pa.schema([("leader", pa.int64()), ("part", pa.int32()), ("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("text", pa.binary()), ("high", pa.int64())])
_PART_SQL = "leader long, part int, doc long, uid long, start long, text binary, high long"


def _rows(spans: list, candidates: list, at_once: int = 2000):
    """Spans have no text, candidates no high."""
    for i in range(0, len(spans), 20 * at_once):
        uid, low, high = zip(*spans[i : i + 20 * at_once])
        none = lambda kind: pa.nulls(len(uid), kind)
        yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int32()), none(pa.int64()), pa.array(uid, pa.int64()), pa.array(low, pa.int64()), none(pa.binary()), pa.array(high, pa.int64())], schema=_PART)
    for i in range(0, len(candidates), at_once):
        cols = list(zip(*candidates[i : i + at_once]))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, _PART)), pa.nulls(len(cols[0]), pa.int64())], schema=_PART)


def _settled(segments: list, least: int, bound: int, onward: bool):
    """Sort segments, ``bound`` bytes at a time, and yield what is found."""
    low, held = 0, 0
    for i, s in enumerate(segments):
        held += len(s[5])
        if held >= bound or i == len(segments) - 1:
            spans, candidates = settle(segments[low : i + 1], least)
            yield from _rows(spans, candidates if onward else [])
            low, held = i + 1, 0


_MET = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("at", pa.int64())])
_DOC = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("entry", pa.int64())])


def _pieces(text: bytes, most: int, least: int):
    """(place, bytes) of pieces that share all but one byte of a window, so that every window is in one of them."""
    for at in range(0, max(1, len(text) - least + 1), most):
        yield at, text[at : at + most + least - 1]


def _minima_of(texts: list, names: list, least: int, k: int, most: int):
    """Anchors of texts as batches of (h, id, at); texts are joined, or cut, to about ``most`` bytes."""

    def found(held):
        raw = b"".join(p for _, _, p in held)
        first = np.concatenate([[0], np.cumsum([len(p) for _, _, p in held])])
        at, key = byte_minima(raw, first, least, k)
        piece = np.searchsorted(first, at, side="right") - 1
        name = np.array([n for n, _, _ in held], np.int64)[piece]
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(name), pa.array(np.array([s for _, s, _ in held], np.int64)[piece] + at - first[piece])], schema=_MET)

    held, size = [], 0
    for name, text in zip(names, texts):
        if len(text) < least:
            continue
        for at, piece in _pieces(text, most, least):
            held.append((name, at, piece))
            size += len(piece)
            if size >= most:
                yield found(held)
                held, size = [], 0
    if held:
        yield found(held)


def _documents(least: int):
    """(doc_id, text) in; (uid, doc_id, entry) out, entry being the row of the first equal text of the task."""

    def run(batches):
        uid, seen = task_base(), {}
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            entry = [seen.setdefault(hashlib.blake2b(t, digest_size=16).digest(), uid + i) if len(t) >= least else uid + i for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + len(texts)), pa.int64()), b.column(0), pa.array(entry, pa.int64())], schema=_DOC)
            uid += len(texts)

    return run


def _anchors(least: int, k: int, most: int, whole: bool):
    """(id, text) in. Whole texts: ids are row numbers, and equal texts of the task are taken once."""

    def run(batches):
        uid, seen = task_base() if whole else 0, set()
        for b in batches:
            names, texts = b.column(0).to_pylist() if not whole else list(range(uid, uid + b.num_rows)), [t or b"" for t in b.column(b.num_columns - 1).to_pylist()]
            uid += len(texts)
            if whole:
                for i, t in enumerate(texts):
                    if len(t) >= least:
                        digest = hashlib.blake2b(t, digest_size=16).digest()
                        if digest in seen:
                            texts[i] = b""
                        seen.add(digest)
            yield from _minima_of(texts, names, least, k, most)

    return run


def _segments(least: int, k: int, bound: int):
    """(doc, uid, start, text, at[], leader[], part[]) in; spans and candidates out."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for doc, uid, base, text, places, leaders, parts in zip(*(b.column(i).to_pylist() for i in range(7))):
                merged: dict[tuple, list] = {}
                for at, leader, part in sorted(zip(places, leaders, parts)):
                    low, high = max(0, at + k - least), min(len(text), at + least)
                    runs = merged.setdefault((leader, part), [])
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
                for (leader, part), runs in merged.items():
                    for low, high in runs:
                        for at, piece in _pieces(text[low:high], bound // 4, least):
                            held.append((leader, part, doc, uid, base + low + at, piece))
                            size += len(piece)
                            if size >= bound:
                                yield from _settled(held, least, bound, True)
                                held, size = [], 0
        yield from _settled(held, least, bound, True)

    return run


def _shards(least: int, bound: int, onward: bool):
    """Segments sorted by shard in; small shards are sorted together."""

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(7))))
        held, size = [], 0
        for _, shard in groupby(rows, key=lambda r: (r[0], r[1], r[6])):
            for r in shard:
                held.append(r[:6])
                size += len(r[5])
            if size >= bound:  # only between shards
                yield from _settled(held, least, size, onward)
                held, size = [], 0
        yield from _settled(held, least, bound, onward)

    return run


def _contested(anchors: DataFrame, stretch: int) -> DataFrame:
    """(id, met: array of (at, leader, part)): anchors met more than once, led by their first place."""
    place = F.struct("id", F.floor(F.col("at") / stretch).cast("int").alias("part"))
    met = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    # stored, so that the join's sides are plain exchanges: a hot hash is split among tasks
    met = store(met.select("h", F.col("first.id").alias("leader"), "first.part"), "met")
    found = store(anchors.join(met, "h").groupBy("id").agg(F.collect_list(F.struct("at", "leader", "part")).alias("met")), "contested")
    drop_table(met)
    return found


def _cut(batches):
    """(uid, doc_id, text, whole, low[], high[]) in; what is left of each text out."""
    for b in batches:
        out = []
        for text, whole, low, high in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
            text = text or b""
            n, removed, spans, kept = len(text), 0, 0, text
            if whole:
                removed, spans, kept = n, 1, b""
            elif low:
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, low, 1)
                np.add.at(edge, high, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed, spans = int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) > 0).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["uid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, least: int = 100, ks: tuple = (40, 70, 90, 100), bound: int = 1 << 20, stretch: int = 1500) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): uid, doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Texts are UTF-8 bytes (null: empty). Every byte of a window of ``least`` bytes that also starts at an earlier
    place goes; places are ordered by doc_id (null last), row number, place in the text. Windows never cross texts,
    may overlap, and are judged on the input. kept (binary: a cut may split a character) is what is left; n_spans
    counts the maximal removed runs. Texts with fewer bytes stay whole; of repeated rows the first stays.
    An empty table gives an empty result. Very long texts are cut into pieces that overlap by a window; a text is in memory as a
    whole when it is read and when it is cut. ``uid`` is the row number of ``shared.with_uid``.

    ``ks``: lengths of anchors, of one round after another, the last one ``least``; ``bound``: bytes that are sorted
    at once; ``stretch``: bytes of a text whose anchors lead one shard. None of them changes a result.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = store(docs.mapInArrow(_documents(least), "uid long, doc_id long, entry long"), "rows")
    order = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "uid")
    entries = rows.groupBy("entry").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    texts, found, made = None, [], []
    for k in ks:
        source = docs.select("text") if texts is None else texts.select("id", "text")
        anchors = store(source.mapInArrow(_anchors(least, k, bound, texts is None), "h long, id long, at long"), "anchors")
        contested = _contested(anchors, stretch)
        drop_table(anchors)
        if texts is None:
            named = contested.join(entries.select(F.col("entry").alias("id"), "first.doc", "first.uid"), "id").select("id", "doc", "uid", "met")
            joined = with_uid(docs.select("text")).withColumnRenamed("uid", "id").join(named.hint("shuffle_hash"), "id").select("doc", "uid", F.lit(0).cast("long").alias("start"), "text", "met.at", "met.leader", "met.part")
        else:
            joined = texts.join(contested.hint("shuffle_hash"), "id").select("doc", "uid", "start", "text", "met.at", "met.leader", "met.part")
        now = store(joined.mapInArrow(_segments(least, k, bound), _PART_SQL), "segments")
        drop_table(contested)
        if texts is not None:
            drop_table(texts)
        texts, salted = None, False
        while True:
            made.append(now)
            found.append(now.where("high is not null").select("uid", F.col("start").alias("low"), "high"))
            segments = now.where("high is null")
            held = segments.groupBy("leader", "part").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") > bound)
            held = store(held.select("leader", "part", F.ceil(F.col("bytes") / bound).cast("int").alias("salts")), "over")
            over = bool(held.head(1))
            if over:
                fit, large = segments.join(held, ["leader", "part"], "left_anti"), segments.join(held, ["leader", "part"])
            else:
                fit = segments
            dealt = fit.select("leader", "part", "doc", "uid", "start", "text", F.lit(0).alias("salt")).repartition("leader", "part").sortWithinPartitions("leader", "part")
            spans = store(dealt.mapInArrow(_shards(least, bound, False), _PART_SQL).select("uid", F.col("start").alias("low"), "high"), "spans")
            found.append(spans)
            made.append(spans)
            if not over:
                break
            if salted and k != ks[-1]:  # unlike windows round common strings: longer anchors part them
                texts = large.select("doc", "uid", "start", "text").distinct().withColumn("id", F.monotonically_increasing_id())
                texts = store(texts, "left")
                break
            dealt = large.select("leader", "part", "doc", "uid", "start", "text", F.pmod(F.xxhash64("uid", "start"), "salts").cast("int").alias("salt")).repartition("leader", "part", "salt").sortWithinPartitions("leader", "part", "salt")
            now, salted = store(dealt.mapInArrow(_shards(least, bound, True), _PART_SQL), "segments"), True
        if texts is None:
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    spans = every.groupBy("uid").agg(F.collect_set(F.struct("low", "high")).alias("s"))
    copies = rows.join(entries.where("copies > 1").select("entry", F.col("first.uid").alias("stays")), "entry").where("uid <> stays").select("uid", F.lit(True).alias("whole"))
    cuts = store(spans.join(copies, "uid", "full").select("uid", F.coalesce("whole", F.lit(False)).alias("whole"), F.col("s.low").alias("low"), F.col("s.high").alias("high")), "cuts")
    for used in (*made, rows):
        drop_table(used)
    out = with_uid(docs).join(cuts.hint("shuffle_hash"), "uid", "left").select("uid", "doc_id", "text", "whole", "low", "high")
    return out.mapInArrow(_cut, "uid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

