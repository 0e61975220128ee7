"""Generation and review of synthetic rows through a provider, and the rows that come of it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, StructType

from ..functions.text import strip, text_key
from .items import TYPES, signature
from .neardup import kept
from .providers import ONCE, Calls, Client, with_replies
from .sampling import SEED, first_occurrences, stratified_sample_exact
from .synthetic import explanation_map, number_candidates

_FLAGS = "struct<" + ",".join(f"{t}:boolean" for t in TYPES) + ">"
# Names of the modes, the score names of each review, and the fields of the four replies.
QUERY_MODE, FULL_MODE = "query_only", "full_generation"
QUERY_SCORES = ("semantic_preservation", "constraint_preservation", "answer_preservation", "leakage_risk", "language_quality")
FULL_SCORES = ("single_answer_validity", "distractor_plausibility", "leakage_risk", "distribution_fit", "language_quality")
REPLIES = {
    "synthetic_query_generation": "candidates array<struct<query:string,intended_query_type_target:string,method_tag:string,rationale:string>>",
    "synthetic_query_review": f"review_status string, review_scores struct<{','.join(f'{s}:double' for s in QUERY_SCORES)}>, failure_modes array<string>, review_summary string",
    "synthetic_full_generation": f"candidates array<struct<query:string,options:array<string>,answer_index:int,query_type_flags:{_FLAGS},correctness_explanation:string,intended_query_type_target:string,distractor_generation_method:string,rationale:string>>",
    "synthetic_full_review": f"review_status string, review_scores struct<{','.join(f'{s}:double' for s in FULL_SCORES)}>, distribution_fit_score double, failure_modes array<string>, review_summary string",
}


def reply_schema(name: str, most: int = 1) -> dict:
    """The strict JSON schema of a reply: every field is required and no other is allowed; scores lie within 0 and 1."""

    def of(kind: DataType, field: str = "") -> dict:
        if isinstance(kind, StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType, f.name) for f in kind}, "required": kind.names, "additionalProperties": False}
        if isinstance(kind, ArrayType):
            limits = {"candidates": {"minItems": 1, "maxItems": most}, "options": {"minItems": 5, "maxItems": 5}}
            return {"type": "array", "items": of(kind.elementType, "text" if field == "failure_modes" else "")} | limits.get(field, {})
        if isinstance(kind, BooleanType):
            return {"type": "boolean"}
        if isinstance(kind, IntegerType):
            return {"type": "integer", "minimum": 0, "maximum": 4}
        if isinstance(kind, DoubleType):
            return {"type": "number", "minimum": 0, "maximum": 1}
        if field == "review_status":
            return {"type": "string", "enum": ["approved", "rejected"]}
        if field == "correctness_explanation":
            pair = {"key": {"type": "string", "minLength": 1}, "value": {"type": "string", "minLength": 1}}
            return {"type": "array", "minItems": 1, "items": {"type": "object", "properties": pair, "required": list(pair), "additionalProperties": False}}
        return {"type": "string"} if field == "text" else {"type": "string", "minLength": 1}

    return of(StructType.fromDDL(REPLIES[name]))


def answer_text(options: Column, answer: Column) -> Column:
    return F.get(F.filter(options, lambda o: o["option_id"] == answer), F.lit(0))["text"]


def shown(flags: Column) -> Column:
    """An item as a provider is shown it: options as texts, the text of the answer, its signature."""
    return F.struct(
        "example_id", "query", F.transform("options", lambda o: o["text"]).alias("options"), "answer_option_id", answer_text(F.col("options"), F.col("answer_option_id")).alias("answer_text"),
        signature(flags).alias("query_type_signature"), flags.alias("query_type_flags"))


def request(name: str, **parts: Column) -> Column:
    """The JSON of a call: the kind of reply wanted, and what it is about."""
    return F.to_json(F.struct(F.lit(name).alias("schema_name"), *[c.alias(n) for n, c in parts.items()]))


def _asked(train: DataFrame, flags: Column, name: str, client: Client, limit: int, most: int, seed: int, calls: Calls) -> DataFrame:
    """(item columns, candidate_pos, c) of a stratified sample of training items; a failed or malformed reply gives no candidates."""
    rows = stratified_sample_exact(train.withColumn("signature", signature(flags)), "example_id", "signature", "pos", limit, seed)
    about = "parent_example" if name == "synthetic_query_generation" else "seed_example"
    asked = with_replies(rows, request(name, **{about: shown(flags), "target_query_type_signature": F.col("signature"), "max_candidates": F.lit(most)}), client, calls)
    # kept, so that plans which read the candidates twice do not ask twice
    return kept(asked.select(*rows.columns, F.posexplode(F.from_json("reply", REPLIES[name])["candidates"]).alias("candidate_pos", "c")))


def _said(text: Column, otherwise: Column) -> Column:
    return F.coalesce(F.when(strip(text) != "", strip(text)), otherwise)


def _provenance(mode: str, model: str, version: str, created_at: str, target: Column) -> list[Column]:
    return [
        F.lit(mode).alias("synthetic_mode"), F.lit(model).alias("generator_model"), F.lit(version).alias("generation_prompt_version"), F.lit(None).cast("string").alias("approval_batch_id"),
        F.lit("pending").alias("review_status"), F.create_map().cast("map<string,double>").alias("review_scores"), F.lit(created_at).alias("created_at"), target.alias("intended_query_type_target"), _said(F.col("c.rationale"), F.lit("")).alias("generation_notes")]


def generate_queries(items: DataFrame, train: DataFrame, client: Client, model: str, created_at: str, limit: int = 75, most: int = 3, seed: int = SEED, version: str = "query-v1", calls: Calls = ONCE) -> DataFrame:
    """New queries for a sample of training items: the item's options, answer and flags, numbered within each item.

    train: pos, example_id, query, options, answer_option_id, query_type_flags; items: example_id, query
    (queries that are known already). The calls are made at once, and their replies kept in the checkpoint folder.
    """
    if most < 1:
        raise ValueError("at least one candidate an item is needed")
    rows = _asked(train, F.col("query_type_flags"), "synthetic_query_generation", client, limit, most, seed, calls)
    rows = rows.select(F.col("example_id").alias("parent_example_id"), F.col("pos").alias("parent_pos"), "candidate_pos", strip(F.col("c.query")).alias("query"), "options", "answer_option_id", "query_type_flags", "signature", "c")
    new = number_candidates(rows, items)
    pos = F.shiftleft(F.col("parent_pos").cast("long"), 20) + F.col("candidate_pos")
    return new.select(pos.alias("pos"), "example_id", "parent_example_id", "query", "options", "answer_option_id", "query_type_flags",
                      *_provenance(QUERY_MODE, model, version, created_at, _said(F.col("c.intended_query_type_target"), F.col("signature"))), _said(F.col("c.method_tag"), F.lit("query_generation")).alias("generation_method"))


def generate_full(items: DataFrame, train: DataFrame, client: Client, model: str, created_at: str, limit: int = 40, most: int = 1, seed: int = SEED, version: str = "full-v1", calls: Calls = ONCE) -> DataFrame:
    """New items after a sample of training items, numbered over all accepted rows (at most ``limit`` times the candidates of a reply).

    A candidate needs a new query, five different options, an answer among them and all flags; rows without are
    left out before the first of equal queries is chosen.
    """
    if most < 1:
        raise ValueError("at least one candidate an item is needed")
    rows = _asked(train, F.col("query_type_flags"), "synthetic_full_generation", client, limit, most, seed, calls)
    rows = rows.select(F.col("example_id").alias("seed_id"), F.struct("pos", "candidate_pos").alias("at"), strip(F.col("c.query")).alias("query"), F.transform("c.options", strip).alias("texts"), "signature", "c")
    rows = rows.withColumn("_key", text_key(F.col("query"))).where((F.col("_key") != "") & (F.size("texts") == 5) & (F.size(F.array_distinct(F.transform("texts", text_key))) == 5) & F.col("c.answer_index").between(0, 4) & ~F.exists(F.array(*[F.col(f"c.query_type_flags.{t}") for t in TYPES]), F.isnull))
    fresh = rows.join(items.select(text_key(F.col("query")).alias("_key")).distinct(), "_key", "left_anti")
    first = first_occurrences(fresh, F.col("_key"), "at")
    numbered = first.withColumn("pos", F.row_number().over(Window.orderBy("at")).cast("long")).withColumn("example_id", F.format_string("synfull-%04d", F.col("pos")))
    options = F.transform("texts", lambda t, i: F.struct(F.concat(F.col("example_id"), F.lit("-opt-"), (i + 1).cast("string")).alias("option_id"), t.alias("text")))
    made = numbered.withColumn("options", options)
    return made.select("pos", "example_id", "query", "options", F.get("options", F.col("c.answer_index"))["option_id"].alias("answer_option_id"), F.col("c.query_type_flags").alias("query_type_flags"), explanation_map(F.col("c.correctness_explanation")).alias("correctness_explanation"),
                       F.array("seed_id").alias("seed_example_ids"), *_provenance(FULL_MODE, model, version, created_at, _said(F.col("c.intended_query_type_target"), F.col("signature"))),
                       _said(F.col("c.distractor_generation_method"), F.lit("template_conditioned_generation")).alias("distractor_generation_method"), F.lit(None).cast("double").alias("distribution_fit_score"))


def review(rows: DataFrame, sources: DataFrame, client: Client, model: str, reviewed_at: str, full: bool = False, version: str = "review-v1", calls: Calls = ONCE) -> DataFrame:
    """``rows`` with the reviewer's status, scores and summary in place of the old ones.

    ``sources``: example_id, query of items; the parent, or the seeds that are found, go into the request. A failed or malformed
    reply leaves the row pending, with the error in review_summary. Scores of full rows also hold distribution_fit_score.
    """
    name = "synthetic_full_review" if full else "synthetic_query_review"
    known = sources.select(F.col("example_id").alias("_id"), F.struct("example_id", "query").alias("_source"))
    links = rows.select("example_id", F.explode("seed_example_ids" if full else F.array("parent_example_id")).alias("_id")).join(known, "_id")
    shown_with = links.groupBy("example_id").agg(F.array_sort(F.collect_list("_source")).alias("_sources"))
    joined = rows.join(shown_with, "example_id", "left")
    if not full and joined.where("_sources is null").head(1):
        raise ValueError("a row's parent is not among the items")
    what = F.struct("example_id", "query", F.transform("options", lambda o: o["text"]).alias("options"), answer_text(F.col("options"), F.col("answer_option_id")).alias("answer_text"))
    asked = with_replies(joined, request(name, candidate=what, sources=F.col("_sources")), client, calls)
    asked = asked.withColumn("_v", F.from_json("reply", REPLIES[name]))
    good = F.coalesce(F.col("_v.review_status").isin("approved", "rejected") & F.col("_v.review_scores").isNotNull(), F.lit(False))
    scores = F.from_json(F.to_json("_v.review_scores"), "map<string,double>")
    if full:
        fit = F.col("_v.distribution_fit_score")
        scores = F.map_concat(scores, F.when(fit.isNotNull(), F.create_map(F.lit("distribution_fit_score"), fit)).otherwise(F.create_map().cast("map<string,double>")))
        asked = asked.withColumn("distribution_fit_score", F.when(good, fit))
    new = {
        "review_status": F.when(good, F.col("_v.review_status")).otherwise("pending"), "review_scores": F.when(good, scores).otherwise(F.create_map().cast("map<string,double>")),
        "review_summary": F.when(good, strip(F.col("_v.review_summary"))).otherwise(F.concat(F.lit("no review: "), F.coalesce("error", F.lit("malformed reply")))),
        "reviewer_model": F.lit(model), "reviewed_at": F.lit(reviewed_at), "review_prompt_version": F.lit(version)}
    return asked.select(*[c for c in joined.columns if c not in new and c not in ("_sources", "distribution_fit_score")], *(["distribution_fit_score"] if full else []), *[c.alias(n) for n, c in new.items()])


def to_items(rows: DataFrame) -> DataFrame:
    """Synthetic rows of either kind as items; all else of a row becomes its source_metadata (JSON)."""
    own = ["example_id", "query", "options", "answer_option_id", "query_type_flags"]
    rest = [c for c in rows.columns if c not in (*own, "pos")]
    return rows.select(*own, F.to_json(F.struct(*rest)).alias("source_metadata"))


def fake_client(reply_of: dict[str, object]):
    """A client that gives the same reply to each kind of request; for dry runs and tests."""

    def factory():
        return lambda text: reply_of[json.loads(text)["schema_name"]]

    return factory
