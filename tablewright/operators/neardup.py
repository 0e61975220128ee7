"""Near duplicates in order: a row goes if it is close to an earlier row that stays."""

from __future__ import annotations

import difflib
import math
import re
import tempfile

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import jaccard, text_key, tokens


@F.pandas_udf(DoubleType())
def sequence_ratio(later: pd.Series, earlier: pd.Series) -> pd.Series:
    """The standard library's matching-blocks ratio; it depends on the order of its arguments."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(later, earlier)])


def score(later: Column, earlier: Column) -> Column:
    """max(sequence ratio, word Jaccard) of two keys; 0 if either is empty."""
    both = (later != "") & (earlier != "")
    return F.when(both, F.greatest(sequence_ratio(later, earlier), jaccard(tokens(later), tokens(earlier)))).otherwise(0.0)


@F.pandas_udf(DoubleType())
def _bounded_ratio(later: pd.Series, earlier: pd.Series, threshold: pd.Series) -> pd.Series:
    """sequence_ratio where it may reach the threshold, by its cheap upper bounds; else 0."""

    def one(a: str, b: str, least: float) -> float:
        m = difflib.SequenceMatcher(None, a, b)
        return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0

    return pd.Series([one(*x) for x in zip(later, earlier, threshold)])


def edits(one: int, other: int, threshold: float) -> int:
    """Insertions and deletions between texts of these lengths whose ratio reaches the threshold, at most; they are odd when the lengths differ by an odd number."""
    most = math.floor((1 - threshold) * (one + other) + 1e-9)
    return most - (most - other + one) % 2


#: Letters a segment has at most at each level, but for texts that few edits would spoil.
FINENESS = (24, 8, 3)
#: Pairs that a block may make before its texts are cut finer.
HOT = 10_000


def _partition(n: int, threshold: float, level: int) -> tuple[list[tuple[int, int]], int]:
    """(segments of a text of length n, how many of them may be spoiled by edits); more of them, and so shorter ones, at higher levels."""
    most = max(edits(n, other, threshold) for other in range(n, math.floor(n * (2 - threshold) / threshold + 1e-9) + 1))
    parts = max(most + 1, min(n, max(most + 3, n // FINENESS[level])))
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)], most


def _segments(threshold: float, level: int):
    """(node, scope, key) in; (node, scope, probe, block, need) out.

    Of two texts whose ratio reaches the threshold, the shorter one's segments are the blocks of the index; the
    longer one probes with its substrings where a segment can have moved to: a shift costs edits before the
    segment, and the rest of the difference in length costs edits behind it. A text has ``need`` blocks too
    many to lose them all to edits, however they are chosen.
    """
    plans: dict[int, tuple] = {}
    shifts: dict[int, list] = {}

    def plan(n):
        if n not in plans:
            plans[n] = _partition(n, threshold, level)
        return plans[n]

    def reach(n):
        """(shorter length, first and last shift) of the partners of a text of length n."""
        if n not in shifts:
            found = []
            for short in range(math.ceil(n * threshold / (2 - threshold) - 1e-9), n + 1):
                most = edits(short, n, threshold)
                if most >= n - short and most > 0:
                    spare = (most - (n - short)) // 2
                    found.append((short, -spare, n - short + spare))
            shifts[n] = found
        return shifts[n]

    def run(batches):
        for b in batches:
            out = []
            for node, scope, key in zip(*(b.column(i).to_pylist() for i in range(3))):
                n = len(key)
                cuts, most = plan(n)
                if most:
                    out += [(node, scope, False, _name(scope, n, i, key[a:z]), most + 1) for i, (a, z) in enumerate(cuts)]
                for short, first, last in reach(n):
                    seen = {_name(scope, short, i, key[s : s + z - a]) for i, (a, z) in enumerate(plan(short)[0]) for s in range(max(0, a + first), min(n - (z - a), a + last) + 1)}
                    out += [(node, scope, True, name, None) for name in seen]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names=["node", "scope", "probe", "block", "need"])

    return run


def _name(scope: int, length: int, place: int, text: str) -> int:
    """A block's hash; those that collide cost a comparison."""
    return xxhash.xxh3_64_intdigest(f"{scope}:{length}:{place}:{text}".encode(errors="surrogatepass")) - (1 << 63)


def edit_candidates(keys: DataFrame, threshold: float, hot: int | None = None) -> DataFrame:
    """(x, y) that hold all pairs of keys (node, key) whose ratio can reach the threshold, some of them twice.

    Of a text's segments only the rarest go to the index, as many as edits cannot spoil. A block that would
    make over ``hot`` pairs is not paired up: its texts are cut again, finer, and meet only where they share a rare
    segment among themselves too.
    """
    hot, levels = HOT if hot is None else hot, len(FINENESS)
    rows, found = keys.select("node", F.lit(0).cast("long").alias("scope"), "key"), None
    for level in range(levels):
        blocks = kept(rows.mapInArrow(_segments(threshold, level), "node long, scope long, probe boolean, block long, need int"))
        index, probes = blocks.where("not probe").select("node", "scope", "block", "need"), blocks.where("probe").select("node", "block")
        asked = probes.groupBy("block").agg(F.count("*").alias("asked"))
        sized = index.groupBy("block").agg(F.count("*").alias("held")).join(asked, "block", "left").withColumn("cost", F.col("held") * F.coalesce("asked", F.lit(0)))
        ranked = index.join(sized, "block").groupBy("node", "scope").agg(F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("cost", "block"))).alias("b"))
        index = kept(ranked.select("node", F.explode(F.slice("b", F.lit(1), F.col("need"))).alias("b")).select("node", "b.block", "b.cost").where("cost > 0"))
        met = index.where(F.col("cost") <= hot) if level < levels - 1 else index
        pairs = met.select(F.col("node").alias("x"), "block").join(probes.withColumnRenamed("node", "y"), "block").where("x <> y").select("x", "y")
        found = pairs if found is None else found.union(pairs)
        often = index.where(F.col("cost") > hot)
        if level == levels - 1 or not often.head(1):
            return found
        left = often.select("node", "block").union(probes.join(often.select("block").distinct(), "block").select("node", "block")).distinct()
        rows = left.withColumnRenamed("block", "scope").join(keys, "node").select("node", "scope", "key")


def _word_blocks(keys: DataFrame, threshold: float) -> DataFrame:
    """Prefix filter: sets whose Jaccard reaches the threshold share one of their rarest words.

    Sets so small that one word too many is too much have one block, of all their words.
    """
    words = keys.select("node", tokens(F.col("key")).alias("ws"))
    size = F.size("ws")
    apart = F.floor(F.lit((1 - threshold) / (1 + threshold)) * (size + F.floor(size / threshold + 1e-9)) + 1e-9)
    whole = words.where(apart < 1).select("node", F.concat(F.lit("="), F.array_join(F.array_sort("ws"), " ")).alias("block"))
    words = words.where(apart >= 1).select("node", F.explode("ws").alias("w"))
    rare = words.groupBy("w").agg(F.count("*").alias("df"))
    ranked = words.join(rare, "w").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    kept = F.slice("ws", F.lit(1), (size - F.ceil(F.lit(threshold) * size - 1e-9) + 1).cast("int"))
    return whole.union(ranked.select("node", F.explode(kept).alias("x")).select("node", F.col("x.w").alias("block")))


def near_pairs(keys: DataFrame, threshold: float) -> DataFrame:
    """(earlier, later, score) of distinct non-empty keys (node: order, key) that reach the threshold."""
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must be above 0.5 and at most 1")
    keys = keys.where("key <> ''").select("node", "key")
    words = kept(_word_blocks(keys, threshold))
    found = words.select(F.col("node").alias("x"), "block").join(words.select(F.col("node").alias("y"), "block"), "block").where("x < y").select("x", "y")
    pairs = edit_candidates(keys, threshold).union(found).select(F.least("x", "y").alias("earlier"), F.greatest("x", "y").alias("later")).distinct()
    left, right = keys.select(F.col("node").alias("earlier"), F.col("key").alias("ek")), keys.select(F.col("node").alias("later"), F.col("key").alias("lk"))
    both = pairs.join(left, "earlier").join(right, "later").withColumn("alike", jaccard(tokens(F.col("lk")), tokens(F.col("ek"))))
    least = F.when(F.col("alike") >= threshold, 0.0).otherwise(threshold)
    score = F.greatest("alike", _bounded_ratio("lk", "ek", least))
    return both.withColumn("score", score).where(F.col("score") >= threshold).select("earlier", "later", "score")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of its own only where none is set and all runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp())
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage in the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _solve(batches):
    """(later, earlier) sorted in; the nodes that go out: a node goes if an earlier one that stays is beside it."""
    gone, now, goes = set(), None, False
    for b in batches:
        for later, earlier in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if later != now:
                if goes:
                    gone.add(now)
                now, goes = later, False
            goes = goes or earlier not in gone
    if goes:
        gone.add(now)
    out = list(gone)
    for i in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 50_000], pa.int64())], names=["node"])


def losers(pairs: DataFrame, bound: int = 1 << 20, rounds: list | None = None) -> DataFrame:
    """The nodes of pairs (earlier, later) that are not in the graph's first independent set in order of the nodes.

    Rounds over all nodes at once: those without an earlier neighbour stay, and their neighbours go. Pairs of the
    first nodes, ``bound`` at a time, are decided in one task in between, however long a chain they make; as soon as no more than
    that are left, they end the matter. ``rounds`` collects what is left before each.
    """
    left, gone = kept(pairs.select("earlier", "later")), []

    def without(edges: DataFrame, lost: DataFrame) -> DataFrame:
        gone.append(lost)
        for side in ("later", "earlier"):
            edges = edges.join(lost.withColumnRenamed("node", side), side, "left_anti")
        return kept(edges.select("earlier", "later"))

    while n := left.count():
        if rounds is not None:
            rounds.append(n)
        if n <= bound:
            gone.append(kept(_in_order(left)))
            break
        roots = left.select("earlier").distinct().join(left.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        left = without(left, kept(left.join(roots, "earlier", "left_semi").select(F.col("later").alias("node")).distinct()))
        cut = left.agg(F.percentile_approx("later", bound / n, 10_000)).first()[0]
        if cut is None:
            break
        lost = kept(_in_order(left.where(F.col("later") <= cut)))
        behind = left.where(F.col("later") > cut)
        stay = behind.where(F.col("earlier") <= cut).join(lost.withColumnRenamed("node", "earlier"), "earlier", "left_anti")
        left = without(behind, kept(lost.union(stay.select(F.col("later").alias("node")).distinct())))
    if not gone:
        return pairs.select(F.col("later").alias("node")).limit(0)
    out = gone[0]
    for more in gone[1:]:
        out = out.union(more)
    return out.distinct()


def _in_order(pairs: DataFrame) -> DataFrame:
    rows = pairs.select("later", "earlier").repartition(1).sortWithinPartitions("later", "earlier")
    return rows.mapInArrow(_solve, "node long")


def greedy_keep(rows: DataFrame, text: Column, pos: str = "pos", threshold: float = 0.995, blocks: Column | None = None) -> DataFrame:
    """``rows`` with ``near_duplicate_of``: the first earlier row that stays and is close, or null.

    Rows are taken in order of ``pos`` (unique). What stays is the first independent set of the similarity graph
    in that order (``losers``). ``blocks``: rows for which it is false never make others go.
    Empty keys are close to nothing. Equal keys are one node, so copies make no pairs.
    """
    rows = rows.withColumn("_key", text_key(text)).withColumn("_blocks", F.lit(True) if blocks is None else blocks)
    first = F.min(F.when(F.col("_blocks"), F.col(pos)))
    every = kept(rows.where("_key <> ''").groupBy(F.col("_key").alias("key")).agg(F.min(pos).alias("node"), first.alias("blocker")))
    nodes = every.where("blocker is not null").select("key", F.col("blocker").alias("node"))
    pairs = kept(near_pairs(nodes, threshold).select("earlier", "later"))
    gone = losers(pairs)
    stays = nodes.join(gone, "node", "left_anti")
    own = stays.select("key", F.col("node").alias("near"))
    other = pairs.join(gone.withColumnRenamed("node", "earlier"), "earlier", "left_anti").join(nodes.withColumnRenamed("node", "later"), "later").select("key", F.col("earlier").alias("near"))
    near = own.union(other)
    if blocks is not None:  # rows that do not block may still be close to one that stays
        extra = every.where("blocker is null or node < blocker").select("node", "key")
        near = near.union(near_pairs_between(extra, stays.select("key", "node"), threshold))
    near = near.groupBy("key").agg(F.min("near").alias("near"))
    out = rows.join(near, rows["_key"] == near["key"], "left").drop("key")
    return out.withColumn("near_duplicate_of", F.when(F.col("near") < F.col(pos), F.col("near"))).drop("near", "_key", "_blocks")


def near_pairs_between(keys: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """(key, near) of keys close to others (node, key), whichever comes first."""
    both = keys.select((F.col("node") * 2 + 1).alias("node"), "key").union(others.select((F.col("node") * 2).alias("node"), "key"))
    pairs = near_pairs(both, threshold)
    odd = F.when(F.col("earlier") % 2 == 1, F.col("earlier")).otherwise(F.col("later"))
    even = F.when(F.col("earlier") % 2 == 1, F.col("later")).otherwise(F.col("earlier"))
    found = pairs.where("earlier % 2 <> later % 2").select(odd.alias("o"), even.alias("e")).select(((F.col("o") - 1) / 2).cast("long").alias("node"), (F.col("e") / 2).cast("long").alias("near"))
    return found.join(keys, "node").select("key", "near")
