"""Exact stratified allocation, splits and deterministic samples."""

from __future__ import annotations

import hashlib
import random
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neardup import kept

SEED = 1508
RATIOS = (("train", 0.70), ("validation", 0.15), ("test", 0.15))


def allocate(groups: DataFrame, target: Column, name: str = "name", size: str = "n") -> DataFrame:
    """Largest-remainder shares of ``target`` over few groups (name, n): floor, then one more by (-remainder, name)."""
    every = Window.partitionBy()
    exact = F.col(size) * target / F.sum(size).over(every)
    out = groups.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.col("_floor"))
    out = out.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("_rest"), name))).withColumn("_left", target - F.sum("_floor").over(every))
    return out.withColumn("allocated", (F.col("_floor") + (F.col("_rn") <= F.col("_left")).cast("long")).cast("long")).drop("_floor", "_rest", "_rn", "_left")


def split_sizes(df: DataFrame, strata: str, ratios=RATIOS) -> DataFrame:
    """(stratum, n, train, validation, test): train first, validation on what is left, the rest is test."""
    sizes = df.groupBy(F.col(strata).alias("name")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    sizes = sizes.withColumn("_t", F.floor(total * ratios[0][1])).withColumn("_v", F.floor(total * ratios[1][1]))
    first = allocate(sizes, F.col("_t")).withColumnRenamed("allocated", "train").withColumn("_left", F.col("n") - F.col("train"))
    second = allocate(first, F.col("_v"), size="_left").withColumnRenamed("allocated", "validation")
    return second.select(F.col("name").alias(strata), "n", "train", "validation", (F.col("n") - F.col("train") - F.col("validation")).alias("test"))


def _assign(ranked: DataFrame, sizes: DataFrame, strata: str) -> DataFrame:
    r = F.col("rank")
    split = F.when(r <= F.col("train"), "train").when(r <= F.col("train") + F.col("validation"), "validation").otherwise("test")
    return ranked.join(sizes.drop("n"), strata).withColumn("split", split).drop("rank", "train", "validation", "test")


def ranked_by_hash(df: DataFrame, key: str, strata: str, seed: int = SEED) -> DataFrame:
    """A rank column from 1 within each stratum, by sha256("seed:key"), then key.

    The hash's first three digits deal a stratum to 4096 parts of about equal size; a rank is the place in its
    part and the sizes of those before. No task sees a stratum whole, however few there are.
    """
    kept = df.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).withColumn("_part", F.substring("_h", 1, 3))
    sizes = kept.groupBy(strata, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(strata).alias("_stratum"), F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    placed = kept.withColumn("_at", F.row_number().over(Window.partitionBy(strata, "_part").orderBy("_h", key)))
    ranked = placed.join(sizes, placed[strata].eqNullSafe(sizes["_stratum"]) & (placed["_part"] == sizes["_of"]))
    return ranked.select(*df.columns, (F.col("_before") + F.col("_at")).alias("rank"))


def _permutations(seed: int):
    """(stratum, size) in; (stratum, at, rank) of each stratum's shuffled numbers out."""

    def run(batches):
        for b in batches:
            for i, (name, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                order = array("q", range(n))
                drawn = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:16]
                random.Random(int(drawn, 16)).shuffle(order)
                for low in range(0, n, 100_000):
                    at = pa.array(order[low : low + 100_000], pa.int64())
                    names = b.column(0).take(pa.array([i] * len(at), pa.int32()))
                    yield pa.RecordBatch.from_arrays([names, at, pa.array(range(low + 1, low + 1 + len(at)), pa.int64())], names=["_stratum", "_at", "rank"])

    return run


def numbered(df: DataFrame, strata: str, pos: str) -> DataFrame:
    """``df`` with _at, the place of a row in its stratum by ``pos`` (unique), from 0: places in ranges of rows, and the sizes of those before."""
    ranged = kept(df.repartitionByRange(strata, pos).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(F.col(strata).alias("_stratum"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_stratum").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_stratum", "_of", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_in", F.row_number().over(Window.partitionBy(strata, "_range").orderBy(pos)) - 1)
    joined = placed.join(sizes, placed[strata].eqNullSafe(sizes["_stratum"]) & (placed["_range"] == sizes["_of"]))
    return joined.select(*df.columns, (F.col("_before") + F.col("_in")).alias("_at"))


def ranked_exact(df: DataFrame, key: str, strata: str, pos: str, seed: int = SEED) -> DataFrame:
    """(key, stratum, rank): each stratum in order of ``pos``, after a Mersenne-Twister shuffle.

    The shuffle's seed is the first 16 hex digits of sha256("seed:stratum"). It depends on that and the stratum's size alone, so
    only numbers are shuffled (8 bytes a row, one sequence of draws a stratum); rows are numbered and joined with
    them, and no task holds a stratum's keys.
    """
    rows = numbered(df.select(key, strata, F.col(pos).alias("_pos")), strata, "_pos")
    kind = df.schema[strata].dataType.simpleString()
    sizes = df.groupBy(F.col(strata).alias("_stratum")).agg(F.count("*").alias("_n")).repartition("_stratum")
    shuffled = sizes.mapInArrow(_permutations(seed), f"_stratum {kind}, _at long, rank long")
    return rows.join(shuffled, rows[strata].eqNullSafe(shuffled["_stratum"]) & (rows["_at"] == shuffled["_at"])).select(key, strata, "rank")


def split_by_hash(df: DataFrame, key: str, strata: str, seed: int = SEED) -> DataFrame:
    """A split column; within a stratum rows go by sha256("seed:key")."""
    return _assign(ranked_by_hash(df, key, strata, seed), split_sizes(df, strata), strata)


def split_exact(df: DataFrame, key: str, strata: str, pos: str, seed: int = SEED) -> DataFrame:
    """(key, stratum, split) by ranked_exact."""
    return _assign(ranked_exact(df, key, strata, pos, seed), split_sizes(df, strata), strata)


def manifest(split: DataFrame, key: str, strata: str, pos: str, seed: int = SEED, ratios=RATIOS) -> DataFrame:
    """One row, the manifest as one object: metadata (strategy, seed, ratios, counts, signature counts) and splits (ids in order of ``pos``).

    A document for readers of one file, so its ids are in one row; the table (split, pos, id) has no such bound.
    """
    names = [n for n, _ in ratios]
    of = lambda n, c: F.when(F.col("split") == n, c)
    ids = [F.transform(F.array_sort(F.collect_list(of(n, F.struct(pos, key)))), lambda x: x[key]).alias(n) for n in names]
    counts = split.groupBy("split", strata).agg(F.count("*").alias("n"))
    figures = counts.agg(
        F.struct(*[F.coalesce(F.sum(of(n, F.col("n"))), F.lit(0)).alias(n) for n in names]).alias("counts"),
        F.struct(*[F.map_from_entries(F.array_sort(F.collect_list(of(n, F.struct(strata, "n"))))).alias(n) for n in names]).alias("query_type_signature_counts"))
    metadata = F.struct(F.lit("stratified_by_query_type_signature").alias("strategy"), F.lit(seed).alias("seed"), F.struct(*[F.lit(r).alias(n) for n, r in ratios]).alias("ratios"), "counts", "query_type_signature_counts")
    return split.agg(F.struct(*ids).alias("splits")).crossJoin(figures).select(metadata.alias("metadata"), "splits")  # one row each


def hash_sample(df: DataFrame, key: Column, limit: int | None, seed: int = SEED, small: int = 10_000) -> DataFrame:
    """The ``limit`` rows with the smallest sha256("seed:key"), of equal keys any; all rows as they are without a limit.

    Beyond ``small`` rows, which tasks keep as they read, the last hash taken is looked up first: counts by its
    digits, four at a time, until few rows share them. What lies below it is a filter; nothing is sorted.
    """
    if limit is None:
        return df
    if limit < 0:
        raise ValueError("limit must not be negative")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    if limit <= small:
        return df.orderBy(hashed.asc_nulls_last()).limit(limit)
    rows = df.withColumn("_h", F.coalesce(hashed, F.lit("g")))  # a null key is last
    digits, left = "", limit
    while True:
        inside = rows.where(F.col("_h").startswith(digits))
        if len(digits) < 64:
            counts = sorted(tuple(r) for r in inside.groupBy(F.substring("_h", 1, len(digits) + 4)).count().collect())  # 65,536 rows or fewer
        else:
            counts = [(digits, inside.count())]
        for digits, n in counts:
            if n > left:
                break
            left -= n
        else:
            return df  # no more rows than the limit
        if not left or n <= small or len(digits) >= 64 or digits == "g":
            break
    below = rows.where(F.col("_h") < digits).drop("_h")
    if not left:
        return below
    last = rows.where(F.col("_h").startswith(digits))
    last = last if len(digits) == 64 else last.orderBy("_h")  # few rows, or equal ones
    return below.unionByName(last.limit(left).drop("_h"))


def _shares(df: DataFrame, strata: str, limit: int) -> DataFrame:
    if limit < 0:
        raise ValueError("limit must not be negative")
    sizes = df.groupBy(F.col(strata).alias("name")).agg(F.count("*").alias("n"))
    return allocate(sizes, F.least(F.lit(limit), F.sum("n").over(Window.partitionBy()))).select(F.col("name").alias(strata), "allocated")


def stratified_sample(df: DataFrame, key: str, strata: str, limit: int, seed: int = SEED) -> DataFrame:
    """``limit`` rows shared out over strata by largest remainders, by hash within each."""
    return ranked_by_hash(df, key, strata, seed).join(_shares(df, strata, limit), strata).where("rank <= allocated").select(*df.columns)


def stratified_sample_exact(df: DataFrame, key: str, strata: str, pos: str, limit: int, seed: int = SEED) -> DataFrame:
    """As stratified_sample, by ranked_exact; all rows if there are no more than ``limit``. ``pos`` gives the original order."""
    taken = ranked_exact(df, key, strata, pos, seed).join(_shares(df, strata, limit), strata).where("rank <= allocated").select(key)
    return df.join(taken, key, "left_semi")


def ratio_targets(train: int, ratio: float, full_share: float, has_query: bool = True, has_full: bool = True) -> tuple[int, int]:
    """(query rows, full rows) for a ratio of synthetic to training rows; halves go to the even number."""
    if ratio < 0 or not 0 <= full_share <= 1:
        raise ValueError("ratio must be at least 0 and full_share within 0 and 1")
    total = round(train * ratio)
    full = round(total * full_share) if has_query and has_full else 0 if has_query else total
    return total - full, full


def first_occurrences(df: DataFrame, key: Column, pos: str) -> DataFrame:
    """The first row by ``pos`` of each key; null keys are one key. A partial minimum, not a window, so a hot key costs one row a task."""
    rows = df.withColumn("_key", key)
    first = rows.groupBy("_key").agg(F.min(pos).alias("_first"))
    return rows.join(first, rows["_key"].eqNullSafe(first["_key"]) & (rows[pos] == first["_first"]), "left_semi").drop("_key")
