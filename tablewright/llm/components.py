"""Connected components of an edge table, wholly in DataFrames (alternating large and small stars)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import store


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star: every node moves to the smallest node it can see."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
    # small star: now u > v; a node's smaller neighbours and itself move to the smallest of them
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    out = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(small.select("u", F.col("m").alias("v"))).distinct()


def _settle(batches):
    """Edges (u, v) in; each node but the smallest of its component with that one out."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (to := up.get(top, top)) != top:
            top = to
        while x != top:
            x, up[x] = up.get(x, x), top
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(u), root(v)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for i in range(0, len(nodes), 50_000):
        part = [(n, r) for n in nodes[i : i + 50_000] if (r := root(n)) != n]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in part], pa.int64()) for j in (0, 1)], names=["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60, bound: int = 1 << 18) -> DataFrame:
    """(node, component): the smallest node of each component, for all nodes with an edge.

    ``edges`` has long columns u and v; loops and repeats are allowed, nulls are dropped. No edges
    give an empty table. Each round is written to the shared folder; only a count and a checksum
    reach the driver. As soon as no more than ``bound`` edges are left, one task ends the matter.
    """
    now = store(edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark or not new[0]:
            break
        mark = tuple(new)
        if new[0] <= bound:
            now = store(now.select("u", "v").coalesce(1).mapInArrow(_settle, "u long, v long"), "stars")
            break
        now = store(_stars(now), "stars")
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
