"""Line deduplication: winnowing over line hashes.

Every run of ``least`` lines holds a selected minimum of its line hashes, whichever document it is in
(a guaranteed fingerprint). Only fingerprints met more than once go on. A fingerprint is extended both
ways to the runs of ``least`` lines around it; of each run the first place (smallest doc_id, row,
line) stays and all later ones are deleted, so adjoining runs delete a longer match as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import window_hash, window_minima
from .shared import drop_finished_shuffles, prepare, store, task_base, with_uid

_ROWS = "h long, uid long, doc_id long, at int, runs array<struct<start:int,w1:bigint,w2:bigint>>"
_RUN = pa.struct([("start", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])


def line_places(text: str | None) -> tuple[list[str], list[int], np.ndarray]:
    """(lines, places of those with a word, their 128-bit hashes as two rows); case counts, white space does not."""
    lines = (text or "").split("\n")
    words = [line.encode().split() for line in lines]
    places = [i for i, w in enumerate(words) if w]
    raw = b"".join([xxhash.xxh3_128_digest(b" ".join(words[i])) for i in places])
    return lines, places, np.frombuffer(raw, np.uint64).reshape(-1, 2).T


def _fingerprints(least: int):
    def run(batches):
        uid = task_base()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashes, other = line_places(text)[2]
                n = len(hashes)
                if n >= least:
                    begin = np.arange(n - least + 1)
                    w1, w2 = (window_hash(np.ascontiguousarray(h), least, s)[: len(begin)].view(np.int64).tolist() for s, h in enumerate((hashes, other)))
                    lowest = [int(hashes[i : i + least].min()) for i in begin.tolist()]
                    for at in window_minima(hashes, np.array([0, n]), least).tolist():
                        h = int(hashes[at])
                        runs = [(i, w1[i], w2[i]) for i in range(max(0, at - least + 1), min(at, n - least) + 1) if lowest[i] == h]
                        out.append((h - (1 << 63), uid, doc_id, at, [dict(zip(("start", "w1", "w2"), r)) for r in runs]))
                uid += 1
            if out:
                h, u, d, at, runs = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(u, pa.int64()), pa.array(d, pa.int64()), pa.array(at, pa.int32()), pa.array(runs, pa.list_(_RUN))], names=["h", "uid", "doc_id", "at", "runs"])

    return run


def _cut(least: int):
    def run(batches):
        for b in batches:
            out = []
            for text, starts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                lines = (text or "").split("\n")
                places = [i for i, line in enumerate(lines) if line.encode().split()]
                gone = {places[j] for s in starts or () for j in range(s, s + least)}
                kept = "\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text or ""
                out.append((len(places), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
            n, m, digest, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["uid", "doc_id", "n_lines", "n_removed", "kept_sha256", "kept_text"])

    return run


def line_dedup(docs: DataFrame, least: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): uid, doc_id, n_lines, n_removed, kept_sha256, kept_text.

    Lines are split at \\n; those without a word ([^\\x20\\x09-\\x0D]+) count for nothing and stay. Lines are
    equal when their words are. A run of ``least`` lines whose words also stand at an earlier place is
    deleted; places are ordered by doc_id (null last), row number, line. Documents with fewer lines
    stay whole. Null text is empty; repeated rows: the later one loses its runs. An empty table gives an
    empty result. ``uid`` is the row number of ``shared.with_uid``.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = store(docs.mapInArrow(_fingerprints(least), _ROWS), "prints")
    met = store(prints.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "met")
    runs = prints.join(met, "h", "left_semi").select("uid", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.explode("runs").alias("r")).select("uid", "doc", "r.start", "r.w1", "r.w2").distinct()
    runs = store(runs, "runs")
    place = F.struct("doc", "uid", "start")
    first = runs.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "first")
    later = runs.join(store(first, "first"), ["w1", "w2"]).where(place > F.col("first")).groupBy("uid").agg(F.collect_list("start").alias("starts"))
    later = store(later, "later")
    drop_finished_shuffles(spark)
    out = with_uid(docs).join(later.hint("shuffle_hash"), "uid", "left").select("uid", "doc_id", "text", "starts")
    return out.mapInArrow(_cut(least), "uid long, doc_id long, n_lines long, n_removed long, kept_sha256 string, kept_text string")
