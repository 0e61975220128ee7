"""A keyed registry of runs: the latest event of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_TYPES, RUN_STATUSES, STAGES = ("train", "eval"), ("running", "completed", "failed"), ("baseline", "candidate", "validated", "archived")
# Metrics that summaries carry, and artifacts by preference.
METRICS = ("overall", "parse_failures", "total_correct", "total", "best_metric", "epoch", "global_step")
ARTIFACTS = ("final_model_dir", "result_json", "output_dir")


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the greatest by ``order``. A partial maximum, so a hot key costs one row a task."""
    rest = [c for c in events.columns if c != key and c not in order]
    top = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return top.select(key, *[F.col("_r")[c].alias(c) for c in [*order, *rest]])


def upsert(registry: DataFrame, entries: DataFrame, key: str = "entry_id") -> DataFrame:
    """Entries replace those of the same key; sorted by created_at."""
    kept = registry.join(entries.select(key).distinct(), key, "left_anti")
    return kept.unionByName(entries).orderBy("created_at", key)


def listed(registry: DataFrame, **equals) -> DataFrame:
    """Rows that match every given (not None) value."""
    for name, value in equals.items():
        if value is not None:
            registry = registry.where(F.col(name) == value)
    return registry


def compared(request: DataFrame, registry: DataFrame, key: str = "entry_id") -> DataFrame:
    """Requested keys (pos, key) in their order, repeats too, with their entries; ``stage`` is empty where unknown."""
    out = request.join(registry, key, "left")
    return out.withColumn("stage", F.coalesce("stage", F.lit(""))) if "stage" in registry.columns else out


def missing(request: DataFrame, registry: DataFrame, key: str = "entry_id") -> DataFrame:
    return request.join(registry, key, "left_anti")


def promote(registry: DataFrame, run_id: str, stage: str, now: str) -> DataFrame:
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    hit = F.col("run_id") == run_id
    return registry.withColumn("stage", F.when(hit, stage).otherwise(F.col("stage"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def primary_artifact(artifacts: Column) -> Column:
    """Path of the preferred artifact, else of the first one, else null."""

    def path(name: str) -> Column:
        return F.get(F.filter(artifacts, lambda a: a["name"] == name), F.lit(0))["path"]

    return F.coalesce(*map(path, ARTIFACTS), F.get(artifacts, F.lit(0))["path"])


def metric_summary(metrics: Column) -> Column:
    return F.map_filter(metrics, lambda k, v: k.isin(*METRICS))


def display_name(base: Column, model: Column) -> Column:
    """Last path segment of an adapter's base with _finetuned; else the model with : and / as _."""
    return F.coalesce(F.concat(F.element_at(F.split(base, "/"), -1), F.lit("_finetuned")), F.translate(model, ":/", "__"))


def text_table(rows: list[dict], columns: list[str]) -> str:
    """A report of few rows: columns as wide as their longest cell, two spaces apart."""
    cells = [columns, *[[str(r.get(c)) for c in columns] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])
