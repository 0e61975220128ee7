"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees the words of the text and the
probabilities of the categories before it. While fitting, those are out-of-fold predictions (a model
never sees the earlier category's fit to its own rows); while scoring, those of the final models.
Fitting uses a bounded sample of labelled rows; scoring runs over every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words
from .shared import prepare, store

BUCKETS = 1 << 20


def word_buckets(texts: list) -> list[np.ndarray]:
    """Sorted distinct hash buckets of each text's lower-cased words (runs of letters and digits)."""
    table = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
    words = Words([None if t is None else t.encode().translate(table) for t in texts], lower=True)
    bucket = (words.hash >> np.uint64(44)).astype(np.int64)
    return [np.unique(bucket[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]


@dataclass
class Linear:
    """A logistic model over chosen word buckets and some dense columns."""

    buckets: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        word = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        if not len(self.buckets):
            return 1 / (1 + np.exp(-(self.bias + dense @ self.dense)))
        at = np.minimum(np.searchsorted(self.buckets, word), len(self.buckets) - 1)
        gain = np.where(self.buckets[at] == word, self.weights[at], 0.0)
        z = self.bias + np.bincount(owner, gain, minlength=len(rows)) + dense @ self.dense
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, features: int, steps: int = 150, ridge: float = 1e-3) -> Linear:
    """Logistic regression by accelerated gradient steps over the buckets that tell the classes apart best.

    At most ``features`` buckets, and no more than positive rows (48 at least): few rows bear few features.
    """
    n, pos = len(y), max(1, int(y.sum()))
    features = min(features, max(48, pos))
    word, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    seen, column = np.unique(word, return_inverse=True)
    with_1 = np.bincount(column, y[owner], minlength=len(seen))
    with_0 = np.bincount(column, 1 - y[owner], minlength=len(seen))
    p1, p0 = (with_1 + 0.5) / (pos + 1), (with_0 + 0.5) / (n - pos + 1)
    gain = np.abs(p1 - p0) / np.sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2 + 1e-3)
    top = np.sort(np.lexsort((seen, -gain))[:features])
    place = np.full(len(seen), -1)
    place[top] = np.arange(len(top))
    keep = place[column] >= 0
    x = np.zeros((n, len(top) + dense.shape[1]), np.float32)
    x[owner[keep], place[column[keep]]] = 1
    x[:, len(top) :] = dense
    w, v, bias, step = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), float(np.log(pos / max(1, n - pos))), 4.0 / max(1e-6, float((x * x).sum(axis=1).mean()))
    vb, yf = bias, y.astype(np.float32)
    for i in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ v + vb, -40, 40))) - yf
        new, nb = v - step * (x.T @ g / n * 8 + ridge * v), vb - step * float(g.mean()) * 8
        momentum = i / (i + 3)
        v, vb = new + momentum * (new - w), nb + momentum * (nb - bias)
        w, bias = new, nb
    return Linear(seen[top], w[: len(top)].astype(np.float64), w[len(top) :].astype(np.float64), float(bias))


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, features: int, folds: int = 3) -> tuple[list[Linear], float]:
    """One model a category, in order, and the last one's threshold (best F-0.5 out of fold). labels: rows x categories."""
    n = len(rows)
    fold, models, oof = np.arange(n) % folds, [], np.zeros((n, 0))
    for c in range(labels.shape[1]):
        y, held = labels[:, c].astype(np.float64), np.zeros(n)
        for f in range(folds):
            fit, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(fit) and len(rest):
                held[rest] = fit_linear([rows[i] for i in fit], oof[fit], y[fit], features).score([rows[i] for i in rest], oof[rest])
        models.append(fit_linear(rows, oof, y, features))
        oof = np.column_stack([oof, held])
    cuts = np.linspace(0.1, 0.9, 17)
    # F-0.5: a wrongly flagged document costs more than a missed one
    score = [1.25 * y[held >= t].sum() / max(1.0, (held >= t).sum() + 0.25 * y.sum()) for t in cuts]
    best = np.flatnonzero(np.array(score) >= max(score) - 1e-9)
    return models, float(cuts[best[len(best) // 2]])


def chain_scores(models: list[Linear], rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), 0))
    for m in models:
        out = np.column_stack([out, m.score(rows, out)])
    return out


def _buckets(batches):
    for b in batches:
        rows = word_buckets(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary())], names=["doc_id", "words"])


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = 6000, features: int = 192) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): doc_id, p_<category> for each, toxic.

    ``categories``: name to SQL expression (0 or 1) over ``labels`` (doc_id, ...), in chain order; the last
    decides toxic, at the threshold that was best out of fold. At most ``sample`` labelled documents
    (smallest hash of doc_id) are used to fit; rows with a null label are left out. Of labels that repeat a
    doc_id the greatest counts (by the categories in order), of texts that do the last by sort. Null texts have
    no words. Without any labelled row all probabilities are null and nothing is toxic. An empty
    table gives an empty result; repeated rows are scored alike.
    """
    prepare(docs.sparkSession)
    names = list(categories)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.expr(e).cast("int").alias(c) for c, e in categories.items()]).dropna()
    known = known.groupBy("doc_id").agg(F.max(F.struct(*names)).alias("y")).select("doc_id", "y.*")
    known = store(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # at most ``sample`` rows of labels and their documents' buckets reach the driver
    fit = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")).mapInArrow(_buckets, "doc_id long, words binary")
    by_id = {r[0]: r[1:] for r in known.collect()}
    taken = sorted(((r[0], np.frombuffer(r[1], np.int32).astype(np.int64)) for r in fit.collect()), key=lambda r: r[0])
    schema = "doc_id long, " + "".join(f"p_{c} double, " for c in names) + "toxic boolean"
    chain = fit_chain([w for _, w in taken], np.array([by_id[d] for d, _ in taken]), features) if taken else None

    def run(batches):
        for b in batches:
            n = b.num_rows
            if chain is None:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.nulls(n, pa.float64()) for _ in names], pa.array([False] * n)], names=["doc_id", *[f"p_{c}" for c in names], "toxic"])
                continue
            p = chain_scores(chain[0], word_buckets(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, i]) for i in range(len(names))], pa.array(p[:, -1] >= chain[1])], names=["doc_id", *[f"p_{c}" for c in names], "toxic"])

    return rows.mapInArrow(run, schema)
