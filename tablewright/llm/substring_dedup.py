"""Substring deduplication with suffix automata.

A window of L consecutive words is repeated when its word sequence starts anywhere else too. To find
all of them without shuffling every window:

1. Anchors. Winnowing over k-word hashes selects a place with the minimum in every L-word window, so
   all copies of a window hold an anchor with the same hash. Only these positions are shuffled; an anchor hash
   met twice is contested, and is led by its first place (smallest row number, then position).
2. Reference shards. Around each contested anchor lies all that windows with this anchor can cover.
   A document's stretches with the same leader are merged into segments and sent to that leader's
   shard: the anchors that a stretch of ``stretch`` words of one row leads. An anchor met more than ``hot``
   times is not led at all (step 4), so a shard has a bound: some ``stretch`` / (L - k) * 2 anchors, each with
   at most ``hot`` segments of 2 L words.
3. Each shard builds a suffix automaton of its distinct segments, with how often each state's
   strings occur, and streams the segments through it: the matching statistic at a word is the
   longest suffix there that occurs at least twice. Spans of L or more are removed. Automata run over the
   words themselves, so hashes that collide cost time, not rows.
4. Hot anchors (a passage that very many documents hold) are split by the words around them: every window
   they are the minimum of is a key of its own, the 128-bit cryptographic digest of its words, counted first in
   each batch. A window costs one row a batch, however many documents hold it, and those that a batch
   holds twice need no more.

The automata are sent to where their segments are rather than broadcast to every machine, as the
reference here is the corpus itself and has no size bound.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .hashing import Words, digest64, sliding_minimum, window_minima
from .shared import drop_finished_shuffles, drop_table, prepare, spare_name, store, task_base, with_uid


class SuffixAutomaton:
    """A suffix automaton of several word sequences, with the number of places of each state's strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.count = [0]

    def _state(self, length: int, link: int, arcs: dict) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(arcs)
        self.count.append(0)
        return len(self.len) - 1

    def _split(self, p: int, q: int, word) -> int:
        """A copy of q that holds only its strings that p reaches."""
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, times: int = 1) -> None:
        """Add a sequence that occurs in ``times`` places."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, word)
            else:
                new = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
                last = new
            count[last] += times

    def finish(self) -> None:
        """Sum the places up the suffix links, longest strings first."""
        count, link = self.count, self.link
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if link[s] > 0:
                count[link[s]] += count[s]

    def repeated(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans [from, to) of an added sequence made of windows of ``least`` words that have two places."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        at, match, spans = 0, 0, []
        for i, word in enumerate(words):
            at, match = nxt[at][word], match + 1
            while at and count[at] < 2:  # matching statistic: the longest suffix here that has another place
                at = link[at]
            if match > length[at]:
                match = length[at]
            if match >= least:
                low = i - least + 1
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = i + 1
                else:
                    spans.append([low, i + 1])
        return [(a, b) for a, b in spans]


def shard_spans(segments: list, least: int) -> list[tuple[int, int, int]]:
    """(uid, from, to) of repeated spans; segments: (uid, start, text of words) of one shard."""
    times: dict[bytes, list] = {}
    for uid, start, text in segments:
        times.setdefault(text, []).append((uid, start))
    out = []
    if len(times) == 1:  # one text: an automaton would tell it repeats wholly if it has two places, or by itself
        (text, places), = times.items()
        words = text.split(b" ")
        if len(places) > 1:
            return [(u, s, s + len(words)) for u, s in places] if len(words) >= least else []
    automaton = SuffixAutomaton()
    split = {text: text.split(b" ") for text in times}
    for text, places in times.items():
        automaton.add(split[text], len(places))
    automaton.finish()
    for text, places in times.items():
        for a, b in automaton.repeated(split[text], least):
            out += [(u, s + a, s + b) for u, s in places]
    return out


_ROWS = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("uid", pa.int64()), ("at", pa.int32()), ("entry", pa.int64())])
_DOC, _ANCHOR = 0, 1


def _anchors(least: int, k: int):
    """Documents (h: number of words) and the anchors of the first of equal documents in the task."""

    def run(batches):
        uid, seen = task_base(), {}
        for b in batches:
            words = Words(b.column(0).to_pylist())
            n = words.n_texts
            uids = uid + np.arange(n)
            uid += n
            sizes = np.diff(words.first)
            entry = uids.copy()
            for i in np.flatnonzero(sizes >= least).tolist():
                entry[i] = seen.setdefault(digest64(words.plain(i)), int(uids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(sizes, pa.int64()), pa.array(uids, pa.int64()), pa.array(np.zeros(n), pa.int32()), pa.array(entry, pa.int64())], schema=_ROWS)
            if not len(words.hash):
                continue
            grams = words.grams(k)
            place = np.flatnonzero(words.full(k) & ((entry == uids) & (sizes >= least))[words.doc])
            first = np.concatenate(([0], np.cumsum(np.bincount(words.doc[place], minlength=n))))
            at = place[window_minima(grams[place], first, least - k + 1)]
            for i in range(0, len(at), 50_000):
                p = at[i : i + 50_000]
                d = words.doc[p]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), 1, np.int8)), pa.array(grams[p].view(np.int64)), pa.array(uids[d], pa.int64()), pa.array(p - words.first[d], pa.int32()), pa.nulls(len(p), pa.int64())], schema=_ROWS)

    return run


_PARTS = pa.schema([("leader", pa.int64()), ("part", pa.int32()), ("uid", pa.int64()), ("start", pa.int64()), ("text", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int64()), ("high", pa.int64())])


def _parts(least: int, k: int):
    """Documents with their contested anchors (uid, text, at[], leader[], part[]) in; segments and hot windows out.

    A leader of -1 marks a hot anchor.
    """

    def rows(uid, start, h1=None, h2=None, n=None, high=None):
        for i in range(0, len(uid), 50_000):
            part = slice(i, i + 50_000)
            m = len(uid[part])
            long = lambda x: pa.nulls(m, pa.int64()) if x is None else pa.array(x[part], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), long(uid), long(start), pa.nulls(m, pa.binary()), long(h1), long(h2), long(n), long(high)], schema=_PARTS)

    def run(batches):
        for b in batches:
            uids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            words = Words(texts)
            grams = words.grams(k)
            segments, windows, holders = [], [], []
            for d, (uid, at, leader, part) in enumerate(zip(uids, *(b.column(i).to_pylist() for i in range(2, 5)))):
                first, end = int(words.first[d]), int(words.first[d + 1])
                n = end - first
                merged: dict[tuple, list] = {}
                hot = []
                for p, lead, stretch in sorted(zip(at, leader, part)):
                    if lead == -1:
                        hot.append(p)
                        continue
                    low, high = max(0, p + k - least), min(n, p + least)
                    runs = merged.setdefault((lead, stretch), [])
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = high
                    else:
                        runs.append([low, high])
                ends = words.end[first:end]
                starts = words.start[first:end]
                for (lead, stretch), runs in merged.items():
                    for low, high in runs:
                        raw = words.bytes[starts[low] : ends[high - 1]]
                        segments.append((lead, stretch, uid, low, b" ".join(raw.split())))
                if hot:
                    windows.append(np.unique(grams[first + np.array(hot)]))
                    holders.append(d)
            for i in range(0, len(segments), 2000):
                part = list(zip(*segments[i : i + 2000]))
                none = pa.nulls(len(part[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _PARTS)] + [none] * 4, schema=_PARTS)
            if not holders:
                continue
            # a hot anchor's windows: those whose minimum is its hash
            place = np.flatnonzero(words.full(k) & np.isin(words.doc, holders))
            begins = np.concatenate(([0], np.cumsum(np.bincount(words.doc[place], minlength=words.n_texts))))
            lowest, inside = sliding_minimum(grams[place], begins, least - k + 1)
            lowest = grams[place][lowest]
            is_hot = np.zeros(len(place), bool)
            for d, values in zip(holders, windows):
                is_hot[begins[d] : begins[d + 1]] = np.isin(lowest[begins[d] : begins[d + 1]], values)
            at = place[is_hot & inside]
            doc = words.doc[at]
            owner, start = np.array(uids)[doc], at - words.first[doc]
            digest = []
            for d in np.unique(doc).tolist():
                plain = words.plain(d)
                size = np.diff([words.start[words.first[d] : words.first[d + 1]], words.end[words.first[d] : words.first[d + 1]]], axis=0)[0]
                edge = np.concatenate(([0], np.cumsum(size + 1))).tolist()
                digest += [digest64(plain[edge[i] : edge[i + least] - 1]) for i in start[doc == d].tolist()]
            h1, h2 = np.array(digest, np.int64).reshape(-1, 2).T
            order = np.lexsort((start, owner, h2, h1))
            new = np.concatenate(([True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)))[: len(at)]
            times = np.diff(np.append(np.flatnonzero(new), len(at)))
            # windows met twice in this batch are known to be repeated: as spans, and one row for the count
            known = np.sort(order[np.repeat(times, times) > 1])
            if len(known):
                edge = np.concatenate(([True], (np.diff(owner[known]) != 0) | (np.diff(start[known]) > least)))
                low, high = known[edge], known[np.append(np.flatnonzero(edge)[1:], len(known)) - 1]
                yield from rows(owner[low], start[low], high=start[high] + least)
            one = order[new]
            yield from rows(owner[one], start[one], h1=h1[one], h2=h2[one], n=times)

    return run


def _shards(least: int):
    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
        out = []
        for _, shard in groupby(rows, key=lambda r: r[:2]):
            out += shard_spans([r[2:] for r in shard], least)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["uid", "low", "high"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["uid", "low", "high"])

    return run


def _left(text: str | None, all_of_it: bool, low: list, high: list) -> tuple[int, list[bytes]]:
    """The number of words of a text, and those that are not in spans."""
    words = (text or "").encode().split()
    n = len(words)
    if all_of_it:
        words = []
    elif low:
        gone = np.zeros(n + 1, np.int32)
        np.add.at(gone, low, 1)
        np.add.at(gone, high, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return n, words


def _cut(batches):
    """(uid, doc_id, text, whole, low[], high[]) in; what is left of each text out."""
    for b in batches:
        uid, doc_id, texts, whole, lows, highs = (b.column(i) for i in range(6))
        found = []
        for row in zip(texts.to_pylist(), whole.to_pylist(), lows.to_pylist(), highs.to_pylist()):
            n, words = _left(*row)
            kept = b" ".join(words)
            found.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
        cols = list(zip(*found)) if found else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([uid, doc_id, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["uid", "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


@F.arrow_udf(StringType())
def _cut_text(text: pa.Array, whole: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """What is left of a text; null for a text without spans, which is given as null."""
    rows = zip(text.to_pylist(), whole.to_pylist(), low.to_pylist(), high.to_pylist())
    return pa.array([None if row[0] is None else b" ".join(_left(*row)[1]).decode() for row in rows], pa.string())


def substring_dedup(docs: DataFrame, least: int = 35, k: int = 8, hot: int = 128, stretch: int = 256) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): uid, doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text (null: none). Every word of a window of ``least``
    words whose sequence also starts anywhere else, in the same document too, is removed; all copies
    go, and windows are judged on the input. kept_text is what is left, joined by one space. Documents
    with fewer words are left alone. Repeated rows are copies of each other. An empty table gives an
    empty result. ``uid`` is the row number of ``shared.with_uid``.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = _repeats(docs, least, k, hot, stretch)
    out = with_uid(docs).join(found.hint("shuffle_hash"), "uid", "left").select("uid", "doc_id", "text", "whole", "low", "high")
    return out.mapInArrow(_cut, "uid long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def _repeats(docs: DataFrame, least: int = 35, k: int = 8, hot: int = 128, stretch: int = 256) -> DataFrame:
    """(uid, whole, low[], high[]), stored: the spans of words that go, of rows with any. docs: text (a string)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = store(docs.select("text").mapInArrow(_anchors(least, k), "kind byte, h long, uid long, at int, entry long"), "anchors")
    anchors = rows.where(f"kind = {_ANCHOR}").select("h", "uid", "at")
    place = F.struct("uid", F.floor(F.col("at") / stretch).cast("int").alias("part"))
    met = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    # stored, so that the join's sides are plain exchanges: a hot hash is split among tasks
    met = store(met.select("h", F.when(F.col("n") > hot, -1).otherwise(F.col("first.uid")).cast("long").alias("leader"), "first.part"), "met")
    contested = store(anchors.join(met, "h").groupBy("uid").agg(F.collect_list(F.struct("at", "leader", "part")).alias("met")), "contested")
    drop_finished_shuffles(spark)
    text = with_uid(docs.select("text")).select("uid", "text").join(contested.hint("shuffle_hash"), "uid")
    parts = store(text.select("uid", "text", "met.at", "met.leader", "met.part").mapInArrow(_parts(least, k), "leader long, part int, uid long, start long, text binary, w1 long, w2 long, n long, high long"), "parts")
    drop_finished_shuffles(spark)
    shards = parts.where("leader is not null").select("leader", "part", "uid", "start", "text").repartition("leader", "part").sortWithinPartitions("leader", "part")
    spans = shards.mapInArrow(_shards(least), "uid long, low long, high long")
    spans = spans.union(parts.where("high is not null").select("uid", F.col("start").alias("low"), "high"))
    windows = parts.where("w1 is not null").select("w1", "w2", "uid", "start", "n")
    twice = store(windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2"), "twice")
    lone = windows.where("n = 1").join(twice, ["w1", "w2"], "left_semi")
    spans = spans.union(lone.select("uid", F.col("start").alias("low"), (F.col("start") + least).alias("high")))
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("s"))
    # documents with an equal one in the same map task are wholly repeated
    mapped = rows.where(f"kind = {_DOC}")
    copies = mapped.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1").select("entry")
    whole = mapped.join(copies, "entry").select("uid", F.lit(True).alias("whole"))
    found = store(spans.join(whole, "uid", "full").select("uid", F.coalesce("whole", F.lit(False)).alias("whole"), F.col("s.low").alias("low"), F.col("s.high").alias("high")), "spans")
    for passed in (rows, met, contested, parts, twice):
        drop_table(passed)
    drop_finished_shuffles(spark)
    return found


def drop_repeats(docs: DataFrame, least: int = 35) -> DataFrame:
    """``docs`` without its repeated passages; a document with one becomes its kept words joined by spaces (n_chars follows).

    Documents of which nothing is left are dropped; all others keep their columns, and their text if nothing was
    removed, so null and empty texts stay as they are. Repeated rows of ``least`` words or more are repeats of each
    other. An empty table gives an empty result.
    """
    row, cut = spare_name(docs, "_row"), spare_name(docs, "_cut")
    found = _repeats(docs.select(F.col("text").cast("string")), least).select(F.col("uid").alias(row), F.struct("whole", "low", "high").alias(cut))
    # the one shuffle of texts: they are cut where they meet their spans
    out = docs.withColumn(row, F.monotonically_increasing_id()).join(found.hint("shuffle_hash"), row, "left")
    span = F.col(cut)
    out = out.withColumn(cut, _cut_text(F.when(span.isNotNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))), span["whole"], span["low"], span["high"]))
    out = out.where(F.col(cut).isNull() | (F.col(cut) != "")).withColumn("text", F.coalesce(cut, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
