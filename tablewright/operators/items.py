"""Items: normalising, validating, expanding."""

from __future__ import annotations

import os
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewrite import variants
from ..functions.text import strip

# Names of the types, in order.
TYPES = ("Specific", "Commonsense", "Negated", "Analogical", "Temporal")


def signature(flags: Column) -> Column:
    """Names of the active flags joined by |, None without any."""
    active = F.array_compact(F.array(*[F.when(flags[t], F.lit(t)) for t in TYPES]))
    return F.when(F.size(active) > 0, F.array_join(active, "|")).otherwise("None")


def _blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def flag_values(flags: Column) -> Column:
    """Flags (map of name to variant) as 0 and 1; what is neither a number nor a truth value is null."""
    kind = lambda v: F.schema_of_variant(v)
    return F.transform_values(flags, lambda k, v: F.when(kind(v).isin("BOOLEAN", "BIGINT", "DOUBLE") | kind(v).startswith("DECIMAL"), F.try_variant_get(v, "$", "double")))


def explanation_lists(explanation: Column) -> Column:
    """An explanation (map of key to variant, a text or a list of texts) as a map of key to list; anything else is null."""
    kind = lambda v: F.schema_of_variant(v)
    return F.transform_values(explanation, lambda k, v: F.when(kind(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))).when(kind(v).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(v, "$", "array<string>")))


def raw_violation(query: Column, flags: Column, options: Column, answer: Column, explanation: Column) -> Column:
    """The first check that a raw record fails, or null.

    flags: map of name to variant; options: map of id to text; explanation: map of key to variant.
    """
    flags, explanation = flag_values(flags), explanation_lists(explanation)
    ids, texts = F.map_keys(options), F.map_values(options)
    checks = [
        (query.isNull() | flags.isNull() | options.isNull() | answer.isNull() | explanation.isNull(), "missing keys"),
        (_blank(query), "query must be a non-empty string"),
        (F.array_sort(F.map_keys(flags)) != F.array(*map(F.lit, sorted(TYPES))), "query_type keys"),
        (F.exists(F.map_values(flags), lambda v: v.isNull() | ~v.isin(0, 1)), "query_type must be boolean-like"),
        (F.size(options) != 5, "must contain exactly 5 options"),
        (F.exists(ids, _blank), "invalid option id"),
        (F.exists(texts, _blank), "option must be a non-empty string"),
        (~F.coalesce(F.array_contains(ids, answer), F.lit(False)), "answer must match one option id"),
        (F.size(explanation) < 1, "explanation must be a non-empty mapping"),
        (F.exists(F.map_keys(explanation), _blank), "explanation keys must be non-empty"),
        (F.exists(F.map_values(explanation), lambda v: v.isNull() | (F.size(v) < 1) | F.exists(v, _blank)), "explanation values must be non-empty"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in checks])


def item_violation(options: Column, answer: Column) -> Column:
    """The first check that a prepared item fails: option count, distinct ids, answer among them."""
    ids = F.transform(options, lambda o: o["option_id"])
    return F.coalesce(
        F.when(F.size(options) != 5, "must contain exactly 5 options"),
        F.when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate option ids"),
        F.when(F.exists(options, lambda o: _blank(o["option_id"]) | _blank(o["text"])), "blank option"),
        F.when(~F.coalesce(F.array_contains(ids, answer), F.lit(False)), "answer must match one option id"))


def first_violation(df: DataFrame, violation: str = "violation", pos: str = "pos") -> DataFrame:
    """The row that a reader in order would fail at."""
    return df.where(F.col(violation).isNotNull()).groupBy().agg(F.min(F.struct(pos, violation)).alias("v")).where("v is not null").select("v.*")


def normalise(raw: DataFrame, path: str = "") -> DataFrame:
    """Raw records (pos, query, query_type, options map, answer, correctness_explanation) to items.

    Ids by place, stripped query, options in order; the explanation as it is; where a record came from and what
    was done to it is in source_metadata.
    """
    query = strip(F.col("query"))
    steps = F.when(query != F.col("query"), F.array(F.lit("strip_query_outer_whitespace"))).otherwise(F.array().cast("array<string>"))
    flags = flag_values(F.col("query_type"))
    # fixed value: the format of the ids
    return raw.select(
        "pos", F.format_string("rmpr-%04d", F.col("pos") + 1).alias("example_id"), query.alias("query"),
        F.transform(F.map_entries("options"), lambda e: F.struct(e["key"].alias("option_id"), e["value"].alias("text"))).alias("options"),
        F.col("answer").alias("answer_option_id"),
        F.struct(*[(flags[t] == 1).alias(t) for t in TYPES]).alias("query_type_flags"), "correctness_explanation",
        F.struct(F.lit(path).alias("raw_dataset_path"), F.col("pos").cast("long").alias("raw_index"), steps.alias("normalization")).alias("source_metadata"))


def stats(items: DataFrame) -> DataFrame:
    """(kind, name, n): the number of items, of each active flag, and of each signature."""
    flags = F.col("query_type_flags")
    active = F.array(*[F.when(flags[t], F.struct(F.lit("flag").alias("kind"), F.lit(t).alias("name"))) for t in TYPES])
    one = lambda kind, name: F.array(F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    each = items.select(F.explode(F.array_compact(F.concat(one("items", F.lit("all")), one("signature", signature(flags)), active))).alias("x"))
    return each.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def model_inputs(scoring: DataFrame, tokenised: Column | None = None) -> DataFrame:
    """Scoring rows (option_rows) with a tokenizer's columns (a struct) beside them; fixed fields win over the tokenizer's."""
    if tokenised is None:
        return scoring
    more = scoring.select("*", tokenised.alias("_t"))
    return more.select(*scoring.columns, *[F.col("_t")[f].alias(f) for f in more.schema["_t"].dataType.names if f not in scoring.columns])


def source_path(path: str, root: str | None = None) -> str:
    """A path relative to ``root`` (the working folder), or as it is if it lies elsewhere."""
    at, base = PurePath(os.path.realpath(path)), os.path.realpath(root or os.getcwd())
    return at.relative_to(base).as_posix() if at.is_relative_to(base) else PurePath(path).as_posix()


def option_rows(items: DataFrame) -> DataFrame:
    """One row per item and option, with its place and whether it is the answer."""
    return items.select("example_id", "query", "answer_option_id", F.size("options").alias("group_size"), F.posexplode("options").alias("option_index", "o")).select(
        "example_id", F.col("o.option_id").alias("option_id"), "option_index", "group_size", "query", F.col("o.text").alias("option_text"),
        (F.col("o.option_id") == F.col("answer_option_id")).cast("int").alias("label"))


def augmented(items: DataFrame, most: int = 2) -> DataFrame:
    """Rule-made variants as new items: flags, explanation and metadata (those of them that ``items`` has) come from the parent.

    The metadata is an object that also names the parent, the strategy and the variant's number, which are columns besides.
    """
    rows = items.select("*", F.posexplode(variants(F.col("query"), most)).alias("variant", "v"))
    made = {"parent_example_id": F.col("example_id"), "augmentation_strategy": F.col("v.strategy"), "variant_index": F.col("variant") + 1}
    own = F.from_json(F.to_json("source_metadata"), "map<string,variant>") if "source_metadata" in items.columns else F.create_map().cast("map<string,variant>")
    own = F.coalesce(F.map_filter(own, lambda k, v: ~k.isin(*made)), F.create_map().cast("map<string,variant>"))
    metadata = F.to_variant_object(F.map_concat(own, F.create_map(*[x for k, v in made.items() for x in (F.lit(k), v.cast("variant"))])))
    carried = [c for c in ("query_type_flags", "correctness_explanation") if c in items.columns]
    return rows.select(
        F.format_string("%s-aug-%02d", F.col("example_id"), F.col("variant") + 1).alias("example_id"), F.col("example_id").alias("parent_example_id"), F.col("v.query").alias("query"),
        F.col("v.strategy").alias("strategy"), (F.col("variant") + 1).alias("variant_index"), "options", "answer_option_id", *carried, metadata.alias("source_metadata"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that are not unique."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def in_split(items: DataFrame, manifest: DataFrame, split: str) -> DataFrame:
    """Items of a split in the manifest's order; ids without an item are in ``missing_from_split``."""
    return manifest.where(F.col("split") == split).select("example_id", F.col("pos").alias("split_pos")).join(items, "example_id")


def missing_from_split(items: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(items, "example_id", "left_anti")
