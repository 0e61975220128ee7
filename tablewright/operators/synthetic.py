"""Synthetic rows: generation and review through a provider, approval gates, admission to training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, text_key
from .neardup import greedy_keep, score
from .providers import Client, with_replies
from .sampling import SEED, first_occurrences, hash_sample, ratio_targets

STATUSES = ("pending", "approved", "rejected")
# Gates in order, as (reason, score, bound, what a missing score counts as).
QUERY_GATES = (
    ("low_answer_preservation", "answer_preservation", 0.95, 0.0),
    ("low_semantic_preservation", "semantic_preservation", 0.90, 0.0),
    ("low_constraint_preservation", "constraint_preservation", 0.90, 0.0),
    ("low_language_quality", "language_quality", 0.90, 0.0),
    ("high_leakage_risk", "leakage_risk", 0.20, 1.0),
)
FULL_GATES = (
    ("low_single_answer_validity", "single_answer_validity", 0.95, 0.0),
    ("low_distractor_plausibility", "distractor_plausibility", 0.90, 0.0),
    ("low_distribution_fit", "distribution_fit_score", 0.70, 0.0),
    ("low_language_quality", "language_quality", 0.90, 0.0),
    ("high_leakage_risk", "leakage_risk", 0.20, 1.0),
)
CLOSE = 0.995


def score_gates(scores: Column, gates=QUERY_GATES) -> list[Column]:
    """Reasons by gate: a reason starting with high bounds its score above, others below; the bound itself passes."""
    out = []
    for reason, name, bound, missing in gates:
        value = F.coalesce(F.try_element_at(scores, F.lit(name)), F.lit(missing))
        out.append(F.when(value > bound if reason.startswith("high") else value < bound, F.lit(reason)))
    return out


def provenance_violation(status: Column, scores: Column, required: list[Column]) -> Column:
    return F.coalesce(
        *[F.when(c.isNull() | (strip(c.cast("string")) == ""), "missing provenance") for c in required],
        F.when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "unknown review status"),
        F.when(scores.isNull() | F.exists(F.map_values(scores), lambda s: s.isNull() | (s < 0) | (s > 1)), "scores must be within 0 and 1"))


def approve_queries(candidates: DataFrame, items: DataFrame, train: DataFrame, threshold: float = CLOSE) -> DataFrame:
    """Candidates (pos, example_id, parent_example_id, query, review_status, review_scores) with ``reason``: null if approved.

    items: example_id, query; train: example_id. The first gate that fails names the reason; only rows that
    pass all others are compared with approved ones before them.
    """
    parents = items.select(F.col("example_id").alias("parent_example_id"), F.col("query").alias("parent_query"))
    known = items.select(text_key(F.col("query")).alias("_key"), F.lit(True).alias("authentic")).distinct()
    trained = train.select(F.col("example_id").alias("parent_example_id"), F.lit(True).alias("trained")).distinct()
    rows = candidates.join(parents, "parent_example_id", "left").join(trained, "parent_example_id", "left").withColumn("_key", text_key(F.col("query"))).join(known, "_key", "left")
    gates = [F.when(F.col("parent_query").isNull(), "missing_parent"), F.when(F.col("trained").isNull(), "parent_not_in_train"), F.when(F.coalesce(F.col("review_status") != "approved", F.lit(True)), "review_not_approved")]
    gates += [*score_gates(F.col("review_scores")), F.when(F.col("authentic"), "exact_duplicate_to_authentic")]
    cheap = rows.withColumn("reason", F.coalesce(*gates))
    passed = cheap.where("reason is null").withColumn("reason", F.when(score(F.col("_key"), text_key(F.col("parent_query"))) >= threshold, F.lit("near_duplicate_to_parent")))
    last = greedy_keep(passed.where("reason is null"), F.col("query"), "pos", threshold)
    last = last.withColumn("reason", F.when(F.col("near_duplicate_of").isNotNull(), F.lit("near_duplicate_to_approved")))
    names = candidates.columns
    return cheap.where("reason is not null").select(*names, "reason").unionByName(passed.where("reason is not null").select(*names, "reason")).unionByName(last.select(*names, "reason"))


def approve_full(candidates: DataFrame, items: DataFrame, train: DataFrame, threshold: float = CLOSE) -> DataFrame:
    """Candidates (pos, example_id, query, options array<string>, seed_example_ids, review_status, review_scores) with ``reason``.

    review_scores holds distribution_fit_score too. A row with equal options never blocks others, but is
    named a near duplicate first.
    """
    seeds = candidates.select("pos", F.explode("seed_example_ids").alias("example_id")).join(train.select("example_id").distinct(), "example_id", "left_anti").select("pos", F.lit(True).alias("unknown_seed")).distinct()
    known = items.select(text_key(F.col("query")).alias("_key"), F.lit(True).alias("authentic")).distinct()
    rows = candidates.join(seeds, "pos", "left").withColumn("_key", text_key(F.col("query"))).join(known, "_key", "left")
    gates = [F.when(F.coalesce(F.col("review_status") != "approved", F.lit(True)), "review_not_approved"), F.when(F.col("unknown_seed"), "seed_not_in_train")]
    cheap = rows.withColumn("reason", F.coalesce(*gates, *score_gates(F.col("review_scores"), FULL_GATES), F.when(F.col("authentic"), "exact_duplicate_to_authentic")))
    distinct = F.size(F.array_distinct(F.transform("options", text_key))) == F.size("options")
    last = greedy_keep(cheap.where("reason is null").withColumn("_distinct", distinct), F.col("query"), "pos", threshold, F.col("_distinct"))
    last = last.withColumn("reason", F.when(F.col("near_duplicate_of").isNotNull(), "near_duplicate_to_approved").when(~F.col("_distinct"), "duplicate_option_texts"))
    names = candidates.columns
    return cheap.where("reason is not null").select(*names, "reason").unionByName(last.select(*names, "reason"))


def rejections(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def admit(train_rows: int, queries: DataFrame | None, full: DataFrame | None, ratio: float | None = None, full_share: float = 0.0, max_query: int | None = None, max_full: int | None = None, seed: int = SEED) -> DataFrame:
    """(example_id, track, ...) of the approved rows that enter training: hash samples of each track, queries first."""
    if queries is None and full is None:
        raise ValueError("at least one approved table is needed")
    if ratio is not None:
        if max_query is not None or max_full is not None:
            raise ValueError("a ratio cannot be combined with limits")
        max_query, max_full = ratio_targets(train_rows, ratio, full_share, queries is not None, full is not None)
    parts = [hash_sample(df, F.col("example_id"), limit, seed).withColumn("track", F.lit(name)) for df, limit, name in ((queries, max_query, "query"), (full, max_full, "full")) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def admission_summary(admitted: DataFrame, train_rows: int, ratio: float | None = None, full_share: float = 0.0) -> DataFrame:
    """One row: how many rows of each track enter training, beside how many authentic ones, and what was asked for."""
    of = lambda track: F.count(F.when(F.col("track") == track, 1))
    return admitted.agg(of("query").alias("synthetic_query_count"), of("full").alias("synthetic_full_count"), F.count("*").alias("total_synthetic_count")).select(
        "*", F.lit(train_rows).cast("long").alias("train_example_count"), F.lit(ratio).cast("double").alias("target_ratio"), F.lit(full_share).cast("double").alias("full_share"))


def collisions(selected: DataFrame, items: DataFrame) -> DataFrame:
    """Ids that must not be: taken from authentic items, or chosen twice."""
    return selected.select("example_id").intersect(items.select("example_id")).union(selected.groupBy("example_id").count().where("count > 1").select("example_id"))


def call_provider(rows: DataFrame, client: Client, key: str = "example_id", payload: str = "payload") -> DataFrame:
    """(key, reply JSON, error) of a client made once a task; a failed call gives an error, not a lost job."""
    return with_replies(rows, F.col(payload), client).select(key, "reply", "error")


def number_candidates(replies: DataFrame, items: DataFrame) -> DataFrame:
    """Generated queries (parent_example_id, parent_pos, candidate_pos, query) that are new, numbered within each parent.

    Empty and authentic keys go first, then all but the first row of each key.
    """
    rows = replies.withColumn("_key", text_key(F.col("query"))).where("_key <> ''")
    fresh = rows.join(items.select(text_key(F.col("query")).alias("_key")).distinct(), "_key", "left_anti").withColumn("_at", F.struct("parent_pos", "candidate_pos"))
    first = first_occurrences(fresh, F.col("_key"), "_at").drop("_at")
    index = F.row_number().over(Window.partitionBy("parent_example_id").orderBy("candidate_pos"))
    return first.withColumn("example_id", F.format_string("%s-sq-%02d", F.col("parent_example_id"), index))


def explanation_map(raw: Column) -> Column:
    """A JSON explanation, as an object or a list of key and value, to map of key to list of texts; the later of equal keys wins."""
    listed = F.from_json(raw, "array<struct<key:string,value:string>>")
    singles = F.transform(listed, lambda e: F.struct(strip(e["key"]).alias("key"), F.array(strip(e["value"])).alias("value")))
    plain = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(strip(e["key"]).alias("key"), F.coalesce(F.from_json(e["value"], "array<string>"), F.array(strip(e["value"]))).alias("value")))
    entries = F.when(strip(raw).startswith("["), singles).otherwise(plain)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)
