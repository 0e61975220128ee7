"""Whitening of embeddings by merging singular value decompositions.

1. The fit list: the distinct vectors in fixed point (grouped with partial aggregation, so a vector met a
   billion times costs one row a task).
2. Each partition reduces its vectors to (n, sums, singular values, right vectors) of its centred rows. All
   dimensions stay, so nothing is lost. Two of these are merged by stacking their scaled vectors and one row,
   the difference of the means times sqrt(na nb / (na + nb)), and decomposing the stack again.
3. Partials are merged in rounds of ``fan`` in Spark; one of them, of the size of dimensions squared, reaches
   the driver.
4. Every row is projected with the model, a closure of a few vectors. The fit list is projected once more, to
   measure how far the whitened covariance is from the identity.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, prepare, store

_STEPS = 256
_PARTIAL = "id long, n long, sums array<bigint>, scale array<double>, axes array<double>"
_PARTIAL_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("scale", pa.list_(pa.float64())), ("axes", pa.list_(pa.float64()))])


@dataclass
class Summary:
    """Centred rows, reduced: n, exact sums, singular values by falling size, and their right vectors as rows."""

    n: int
    sums: np.ndarray
    scale: np.ndarray
    axes: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        sums = x.sum(axis=0)
        return Summary(len(x), sums, *_decompose(x - sums / len(x)))

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = (self.sums / self.n - other.sums / other.n) * np.sqrt(self.n / n * other.n)
        stack = np.vstack([self.scale[:, None] * self.axes, other.scale[:, None] * other.axes, apart])
        return Summary(n, self.sums + other.sums, *_decompose(stack))

    def eigen(self) -> tuple[np.ndarray, np.ndarray]:
        """(eigenvalues of the covariance, unit vectors as rows); a vector's largest entry is positive. Numerically empty ones are left out."""
        full = self.scale > (self.scale[0] if len(self.scale) else 0) * max(self.n, len(self.sums)) * np.finfo(float).eps
        axes = self.axes[full]
        sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]) if len(axes) else np.ones(0)
        return self.scale[full] ** 2 / self.n, axes * sign[:, None]


def _decompose(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, scale, axes = np.linalg.svd(rows, full_matrices=False)
    return scale, axes


def fixed_point(vector: Column) -> Column:
    """floor(256 * entry) of each entry as a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * _STEPS))


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(rows with a vector of finite numbers of the usual length, that length); the length most rows have, the larger of equal ones."""
    inf = F.lit(float("inf"))
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < inf))
    rows = df.where(whole & (F.size(vector) > 0))
    usual = rows.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return (rows.where(F.size(vector) == usual["size"]), usual["size"]) if usual else (rows.limit(0), 0)


def _matrix(column, kind) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _partials(rows_at_once: int):
    def run(batches):
        from pyspark import TaskContext

        held, size, total = [], 0, None

        def reduced():
            part = Summary.of(np.vstack(held))
            return part if total is None else total.merge(part)

        for b in batches:
            if b.num_rows:
                held.append(_matrix(b.column(0), np.int64))
                size += b.num_rows
            if size >= rows_at_once:
                total = reduced()
                held, size = [], 0
        if held:
            total = reduced()
        if total is not None:
            yield _row(TaskContext.get().partitionId(), total)

    return run


def _row(key: int, s: Summary):
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((key, s.n, s.sums, s.scale, s.axes.reshape(-1)), _PARTIAL_ARROW)], schema=_PARTIAL_ARROW)


def _summary(n, sums, scale, axes) -> Summary:
    sums = np.array(sums, np.int64)
    return Summary(n, sums, np.array(scale, float), np.array(axes, float).reshape(len(scale), len(sums)))


def _merged(fan: int):
    """Partials sorted by id in; one for each ``fan`` neighbouring ids out."""

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
        for group, members in groupby(rows, key=lambda r: r[0] // fan):
            total = None
            for _, *data in members:
                one = _summary(*data)
                total = one if total is None else total.merge(one)
            yield _row(group, total)

    return run


def fit(vectors: DataFrame, rows_at_once: int = 4096, fan: int = 16) -> Summary | None:
    """The summary of a table with one column of long arrays of equal length; None for an empty one."""
    parts = store(vectors.mapInArrow(_partials(rows_at_once), _PARTIAL), "svd")
    last = parts.agg(F.max("id")).first()[0]
    if last is None:
        return None
    while last > 0:
        last //= fan
        dealt = parts.repartitionById(last + 1, F.expr(f"cast(id div {fan} as int)")).sortWithinPartitions("id")
        merged = store(dealt.mapInArrow(_merged(fan), _PARTIAL), "svd")
        drop_table(parts)
        parts = merged
    row = parts.first()
    drop_table(parts)
    return _summary(row["n"], row["sums"], row["scale"], row["axes"])


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sum over dimensions of (n x - sums)^2, exact; None where it is over 63 bits."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if most * most * len(sums) < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    wide = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in wide]


def _project(n: int, sums: np.ndarray, values: np.ndarray, axes: np.ndarray):
    mean, to = sums / n, (axes / np.sqrt(values)[:, None]).T

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), np.int64) if b.num_rows else np.zeros((0, len(sums)), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_deviation(x, n, sums), pa.int64()), pa.array(list((x - mean) @ to), pa.list_(pa.float64()))], names=["key", "deviation", "whitened"])

    return run


def _spread(n: int, sums: np.ndarray, values: np.ndarray, axes: np.ndarray):
    """Rows of a partition, whitened, as (n, mean, products of centred columns)."""
    mean, to = sums / n, (axes / np.sqrt(values)[:, None]).T

    def run(batches):
        count, middle, square = 0, np.zeros(len(values)), np.zeros((len(values), len(values)))
        for b in batches:
            if b.num_rows:
                y = (_matrix(b.column(0), np.int64) - mean) @ to
                own, m = y.mean(axis=0), len(y)
                apart = own - middle
                square += (y - own).T @ (y - own) + np.outer(apart, apart) * (count * m / (count + m))
                middle = middle + apart * (m / (count + m))
                count += m
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([middle], pa.list_(pa.float64())), pa.array([square.reshape(-1)], pa.list_(pa.float64()))], names=["n", "mean", "square"])

    return run


def identity_error(vectors: DataFrame, model: Summary, components: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    values, axes = (a[:components] for a in model.eigen())
    k = len(values)
    parts = store(vectors.mapInArrow(_spread(model.n, model.sums, values, axes), "n long, mean array<double>, square array<double>"), "spread")
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    middle = parts.agg(*[(F.sum(at("mean", i) * F.col("n")) / F.sum("n")).alias(f"m{i}") for i in range(k)]).first()
    products = [F.sum(at("square", i * k + j) + F.col("n") * (at("mean", i) - middle[i]) * (at("mean", j) - middle[j])) / F.sum("n") for i in range(k) for j in range(k)]
    covariance = np.array(parts.agg(*[p.alias(f"c{i}") for i, p in enumerate(products)]).first()).reshape(k, k)
    drop_table(parts)
    return float(np.abs(covariance - np.eye(k)).max(initial=0))


def whitening(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row per usable row and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, of another length than most, or holds a null or non-finite entry are left
    out. Entries are floor(256 * entry) in all that follows. n counts the distinct vectors, which alone make the
    covariance (divisor n); deviation is the exact sum of (n * x - sums)^2, null where it needs over 63 bits;
    whitened is the centred vector's projection on the component over the root of its eigenvalue. Components
    fall in eigenvalue; those without variance are left out, so fewer than two distinct vectors give no rows.
    Repeated rows, and rows that repeat a key, each have their own rows; a null key stays null. An empty table
    gives an empty result. Fixed-point sums over all distinct vectors must fit in 63 bits.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    kind = embeddings.schema[key].dataType.simpleString()
    rows, _ = usable(embeddings.select(F.col(key).alias("key"), F.col(vector).alias("v")), "v")
    rows = rows.select("key", fixed_point(F.col("v")).alias("x"))
    distinct = store(rows.select("x").distinct(), "distinct")
    model = fit(distinct)
    out = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    values, axes = (a[:components] for a in model.eigen()) if model else (np.zeros(0), None)
    if not len(values):
        drop_table(distinct)
        return spark.createDataFrame([], out)
    error, trace = identity_error(distinct, model, components), float((model.scale**2).sum() / model.n)
    drop_table(distinct)
    projected = rows.mapInArrow(_project(model.n, model.sums, values, axes), f"key {kind}, deviation long, whitened array<double>")
    placed = projected.select("key", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return placed.select(F.col("key").alias(key), (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
