"""Commands over files: ``python -m tablewright.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from datetime import datetime, timezone
from functools import partial

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, generation, items, metrics, providers, registry, runs, sampling, synthetic, training
from .sources import json_files

ITEM = (
    f"pos long, example_id string, query string, options array<{json_files.OPTION}>, answer_option_id string, query_type_flags {json_files.FLAGS}, correctness_explanation map<string,variant>, "
    "source_metadata variant"
)
MANIFEST = "split string, pos long, example_id string"


def _checked(spark: SparkSession, path: str) -> DataFrame:
    """The items of a raw file, all of them valid."""
    raw = json_files.read_raw(spark, path)
    raw = raw.withColumn("violation", items.raw_violation(*map(F.col, ("query", "query_type", "options", "answer", "correctness_explanation"))))
    bad = items.first_violation(raw).first()
    if bad:
        raise ValueError(f"raw record {bad.pos}: {bad.violation}")
    return items.normalise(raw, items.source_path(path))


def _prepared(spark: SparkSession, path: str) -> DataFrame:
    """The items of a prepared file, all of them valid."""
    rows = json_files.read_lines(spark, path, ITEM)
    bad = items.first_violation(rows.withColumn("violation", items.item_violation(F.col("options"), F.col("answer_option_id")))).first()
    if bad:
        raise ValueError(f"prepared record {bad.pos}: {bad.violation}")
    if items.duplicates(rows, "example_id").head(1):
        raise ValueError("prepared records share an id")
    return rows


def _of_kind(spark: SparkSession, a) -> DataFrame:
    if a.kind not in ("raw", "prepared"):
        raise ValueError(f"unknown kind: {a.kind}")
    return (_checked if a.kind == "raw" else _prepared)(spark, a.input)


def _told(df: DataFrame) -> None:
    """Print a histogram (name, n)."""
    for r in df.orderBy("name").collect():  # a few rows: one a status, strategy or track
        print(f"{r['name']}\t{r.n}")


def prepare_data(spark, a):
    """Items, and their split: as rows, or as one object if the path ends with .json."""
    rows = _checked(spark, a.input)
    json_files.write_lines(rows, a.output, ["pos"])
    signed = rows.withColumn("signature", items.signature(F.col("query_type_flags"))).select("example_id", "signature", "pos")
    split = sampling.split_exact(signed, "example_id", "signature", "pos", a.seed).join(rows.select("example_id", "pos"), "example_id")
    if a.split_output.endswith(".json"):
        json_files.write_document(sampling.manifest(split, "example_id", "signature", "pos", a.seed), a.split_output)
    else:
        json_files.write_lines(split.select("split", "pos", "example_id"), a.split_output, ["pos"])


def validate_data(spark, a):
    print(f"{_of_kind(spark, a).count()} records are valid")


def dataset_stats(spark, a):
    for r in items.stats(_of_kind(spark, a)).orderBy("kind", "name").collect():  # at most 38 rows
        print(f"{r.kind}\t{r['name']}\t{r.n}")


def _manifest(spark, path: str) -> DataFrame:
    """A manifest as one JSON object (.json), or as rows."""
    return json_files.read_manifest(spark, path) if path.endswith(".json") else json_files.read_lines(spark, path, MANIFEST)


def _split(spark, a) -> DataFrame:
    rows, manifest = json_files.read_lines(spark, a.dataset, ITEM), _manifest(spark, a.splits)
    bad = json_files.manifest_violation(manifest).first()
    if bad:
        raise ValueError(f"manifest: {bad.violation}: {bad.value}")
    if items.missing_from_split(rows, manifest).head(1):
        raise ValueError("the manifest names items that are not in the dataset")
    return items.in_split(rows, manifest, a.split)


def _named(place: str):
    """What module:name stands for."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def export_split(spark, a):
    json_files.write_lines(_split(spark, a).drop("split_pos"), a.output, ["pos"])


def augment_train(spark, a):
    a.split = "train"
    rows = items.augmented(_split(spark, a), a.max_variants)
    json_files.write_lines(rows, a.output, ["parent_example_id", "variant_index"])
    _told(metrics.histogram(rows, F.col("strategy")))


def _calls(a) -> providers.Calls:
    """Attempts, and a ledger if one is named; replies in it are told apart by model."""
    return providers.Calls(int(a.attempts), float(a.retry_delay), ledger=a.ledger, scope=a.model)


def _generate(spark, a, full: bool) -> None:
    a.split = "train"
    train, known = _split(spark, a), json_files.read_lines(spark, a.dataset, ITEM)
    make = generation.generate_full if full else generation.generate_queries
    rows = make(known, train, _named(a.client), a.model, runs.now(), a.limit, a.max_candidates_per_seed if full else a.max_candidates_per_parent, a.seed, calls=_calls(a))
    json_files.write_lines(_sound(rows, full), a.output, ["pos"])


def _review(spark, a, full: bool) -> None:
    rows = _synthetic(spark, a.input, full)
    known = json_files.read_lines(spark, a.dataset, ITEM)
    done = generation.review(rows, known, _named(a.client), a.model, runs.now(), full, calls=_calls(a))
    json_files.write_lines(done, a.output, ["pos"])
    _told(metrics.histogram(json_files.read_lines(spark, a.output, done.schema), F.col("review_status")))


def _synthetic(spark, path: str, full: bool, status: str | None = None) -> DataFrame:
    """Synthetic rows, checked: ids, provenance and, if given, the review status of every row."""
    return _sound(json_files.read_full(spark, path) if full else json_files.read_lines(spark, path, json_files.SYNTHETIC_QUERY), full, status)


def _sound(rows: DataFrame, full: bool, status: str | None = None) -> DataFrame:
    """The rows, if all are sound items with their provenance and no two share an id."""
    needed = ["synthetic_mode", "generator_model", "generation_prompt_version", "created_at", "intended_query_type_target", "distractor_generation_method" if full else "parent_example_id"]
    bad = F.coalesce(
        items.item_violation(F.col("options"), F.col("answer_option_id")),
        synthetic.provenance_violation(F.col("review_status"), F.col("review_scores"), [F.col(c) for c in needed]),
        F.when(F.col("synthetic_mode") != (generation.FULL_MODE if full else generation.QUERY_MODE), "wrong synthetic mode"),
        *([F.when(F.coalesce(F.size("seed_example_ids") < 1, F.lit(True)), "no seeds")] if full else []),
        *([F.when(F.col("review_status") != status, f"review status must be {status}")] if status else []))
    first = items.first_violation(rows.withColumn("violation", bad)).first()
    if first:
        raise ValueError(f"synthetic row {first.pos}: {first.violation}")
    if items.duplicates(rows, "example_id").head(1):
        raise ValueError("synthetic rows share an id")
    return rows


def _approve(spark, a, full: bool) -> None:
    rows, known = _synthetic(spark, a.input, full), json_files.read_lines(spark, a.dataset, ITEM)
    a.split = "train"
    train = _split(spark, a).select("example_id")
    if full:  # the gate on the fit reads it among the scores
        fit = F.col("distribution_fit_score")
        scores = F.map_filter("review_scores", lambda k, v: k != "distribution_fit_score")
        gated = rows.withColumn("review_scores", F.when(fit.isNotNull(), F.map_concat(scores, F.create_map(F.lit("distribution_fit_score"), fit))).otherwise(scores))
        judged = synthetic.approve_full(gated.withColumn("_options", F.col("options")).withColumn("options", F.transform("options", lambda o: o["text"])), known, train).drop("options").withColumnRenamed("_options", "options")
    else:
        judged = synthetic.approve_queries(rows, known, train)
    judged = judged.withColumn("approval_batch_id", F.when(F.col("reason").isNull(), a.approval_batch_id).otherwise(F.col("approval_batch_id"))).persist()
    good = judged.where("reason is null").drop("reason")
    if a.max_examples is not None:
        good = good.orderBy("pos").limit(int(a.max_examples))
    json_files.write_lines(good, a.output, ["pos"])
    for r in synthetic.rejections(judged).orderBy("reason").collect():  # one row a reason
        print(f"{r.reason}\t{r.n}")
    judged.unpersist()


def build_synthetic_train(spark, a):
    a.split = "train"
    known, train = json_files.read_lines(spark, a.dataset, ITEM), _split(spark, a).count()
    tracks = [generation.to_items(_synthetic(spark, path, full, "approved")) if path else None for path, full in ((a.query_approved, False), (a.full_approved, True))]
    number = lambda v, kind: None if v is None else kind(v)
    rows = synthetic.admit(train, *tracks, number(a.target_ratio, float), float(a.full_share), number(a.max_query_examples, int), number(a.max_full_examples, int), a.seed).persist()
    if synthetic.collisions(rows, known).head(1):
        raise ValueError("synthetic rows use ids twice, or ids of items")
    json_files.write_lines(rows, a.output, ["track", "example_id"])
    if a.summary_output:
        json_files.write_document(synthetic.admission_summary(rows, train, number(a.target_ratio, float), float(a.full_share)).withColumn("output_path", F.lit(a.output)), a.summary_output)
    _told(metrics.histogram(rows, F.col("track")))
    rows.unpersist()


def run_eval(spark, a):
    inputs = {"dataset": a.dataset, "splits": a.splits}
    if a.parent_run_id:  # the model is the parent's, unless another is named
        found = runs.parent_model(_runs(spark, a.registry), a.parent_run_id)
        inputs["parent_model"], a.model = found, a.model or found
    if not a.model:
        raise ValueError("a model or a parent run is needed")
    with runs.tracked(spark, a.registry, "eval", a.model, a.stage, a.parent_run_id, a.command_line, inputs) as run:
        run["outputs"] = {"output_dir": a.output}
        rows = _split(spark, a).withColumn("pos", F.col("split_pos")).withColumnRenamed("query_type_flags", "flags")
        scored = evaluation.evaluate(rows, _named(a.client), a.eval_mode, None if a.limit is None else int(a.limit), calls=_calls(a))
        json_files.write_lines(scored, f"{a.output}/rows", ["pos"])
        scored = json_files.read_lines(spark, f"{a.output}/rows", scored.schema)
        result = evaluation.summary(scored, a.model, a.split, a.eval_mode)
        json_files.write_lines(result, f"{a.output}/summary")
        json_files.write_listed(result, "results", evaluation.listed(scored), "index", f"{a.output}/result.json")
        found = result.first().asDict(recursive=True)  # one row
        run["metrics"] = {n: found["metrics"][n] for n in ("overall", "parse_failures", "total_correct", "total")}
        run["outputs"]["result_json"] = f"{a.output}/summary"
        print(evaluation.report(found))


def run_train(spark, a):
    """Training sets, and a trainer of the caller's: (sets, folder, model) to a dict of metrics, outputs and metadata.

    With ``--workers`` the trainer runs in that many tasks at once (training.Trainer).
    """
    inputs = {"dataset": a.dataset, "splits": a.splits} | ({"augmented": a.augmented} if a.augmented else {})
    with runs.tracked(spark, a.registry, "train", a.model, a.stage, a.parent_run_id, a.command_line, inputs) as run:
        a.split = "train"
        train, every = _split(spark, a), json_files.read_lines(spark, a.dataset, ITEM)
        more = None
        if a.augmented:
            more = json_files.read_lines(spark, a.augmented, f"{ITEM}, parent_example_id string")
            bad = training.augmentation_violations(more, train).first()
            if bad:
                raise ValueError(f"augmented row {bad.example_id}: {bad.violation}")
        json_files.write_splits(training.training_sets(every, _manifest(spark, a.splits), more), f"{a.output}/sets")
        run["outputs"] = {"output_dir": a.output}
        if a.trainer:
            sets = spark.read.schema("example_id string, prompt string, completion string, split string").json(f"{a.output}/sets")
            result = training.train_together(sets, _named(a.trainer), int(a.workers), a.output, a.model) if a.workers else _named(a.trainer)(sets, a.output, a.model)
            for part in ("metrics", "outputs", "metadata"):
                run[part] |= result.get(part, {})


def _runs(spark, path: str) -> DataFrame:
    return runs.current(runs.read_events(spark, path))


def list_runs(spark, a):
    found = registry.listed(_runs(spark, a.registry), run_type=a.run_type, status=a.status, stage=a.stage).orderBy("created_at")
    names = ["run_id", "run_type", "stage", "status", "model_name", "created_at"]
    if a.format == "json":
        print("\n".join(r[0] for r in found.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).collect()))
    else:
        print(registry.text_table([r.asDict() for r in found.select(*names).collect()], names))


def compare_runs(spark, a):
    entries = _runs(spark, a.registry)
    request = spark.createDataFrame(list(enumerate(a.run_id)), "pos int, run_id string")
    if registry.missing(request, entries, "run_id").head(1):
        raise ValueError("a requested run is not in the registry")
    names = ["run_id", "run_type", "stage", "status", "model_name", "overall", "parse_failures"]
    figure = lambda n: F.try_element_at("metrics", F.lit(n)).alias(n)
    found = registry.compared(request, entries, "run_id").orderBy("pos").select(*names[:5], figure("overall"), figure("parse_failures"), "created_at", "finished_at")
    rows = [r.asDict() for r in found.collect()]  # one row a requested run
    text = json.dumps(rows, indent=2)
    if a.output:
        json_files.write_text(spark, text, a.output)
    print(text if a.format == "json" else registry.text_table(rows, names))


def plot_results(spark, a):
    """The leaderboard of result files as text, and as a chart (SVG) if an output is named. Files that are not there are skipped."""
    board = evaluation.leaderboard(json_files.read_results(spark, a.input), only=a.only, exclude=a.exclude).orderBy(F.desc("percent"), "name")
    rows = [r.asDict() for r in board.collect()]  # one row a result file
    print(registry.text_table(rows, ["name", "split", "total", "correct", "percent", "parse_failures"]))
    if a.output:
        json_files.write_text(spark, evaluation.bar_chart([(r["name"], r["percent"]) for r in rows], a.title), a.output)


def promote_run(spark, a):
    """One event more in the log; with an output, a copy of a registry of one row a run."""
    if a.output is None:
        return runs.promote(spark, a.registry, a.run_id, a.stage)
    entries = json_files.read_registry(spark, a.registry)
    if not entries.where(F.col("run_id") == a.run_id).head(1):
        raise ValueError(f"no run {a.run_id}")
    json_files.write_lines(registry.promote(entries, a.run_id, a.stage, datetime.now(timezone.utc).isoformat()), a.output, ["created_at"])


_CALLS = "attempts=3 retry-delay=2.0 ledger?"
_GENERATE, _APPROVE = f"dataset splits client model output seed=1508 {_CALLS}", "input dataset splits approval-batch-id output max-examples?"
COMMANDS = {
    "prepare-data": (prepare_data, "input output split-output seed=1508"), "validate-data": (validate_data, "input kind=raw"), "dataset-stats": (dataset_stats, "input kind=prepared"),
    "export-split": (export_split, "dataset splits split output"), "augment-train": (augment_train, "dataset splits output max-variants=2"),
    "generate-synthetic-query": (partial(_generate, full=False), f"{_GENERATE} limit=75 max-candidates-per-parent=3"), "generate-synthetic-full": (partial(_generate, full=True), f"{_GENERATE} limit=40 max-candidates-per-seed=1"),
    "review-synthetic-query": (partial(_review, full=False), f"input dataset client model output {_CALLS}"), "review-synthetic-full": (partial(_review, full=True), f"input dataset client model output {_CALLS}"),
    "approve-synthetic-query": (partial(_approve, full=False), _APPROVE), "approve-synthetic-full": (partial(_approve, full=True), _APPROVE),
    "build-synthetic-train": (build_synthetic_train, "dataset splits output query-approved? full-approved? target-ratio? full-share=0.0 max-query-examples? max-full-examples? seed=1508 summary-output?"),
    "run-eval": (run_eval, f"dataset splits split=test model? client registry output eval-mode=generative limit? stage=baseline parent-run-id? {_CALLS}"),
    "run-train": (run_train, "dataset splits model registry output augmented? trainer? workers? stage=candidate parent-run-id?"),
    "list-runs": (list_runs, "registry run-type? status? stage? format=table"), "compare-runs": (compare_runs, "registry run-id+ format=table output?"), "plot-results": (plot_results, "input+ only* exclude* title=Accuracy output?"), "promote-run": (promote_run, "registry run-id stage output?"),
}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tablewright")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = commands.add_parser(name)
        for option in options.split():
            flag, _, default = option.partition("=")
            if default:
                sub.add_argument(f"--{flag}", type=int if default.isdigit() else str, default=int(default) if default.isdigit() else default)
            elif flag[-1] in "+*":  # given once for each value
                sub.add_argument(f"--{flag[:-1]}", action="append", required=flag.endswith("+"))
            else:
                sub.add_argument(f"--{flag.rstrip('?')}", required=not flag.endswith("?"))
    a = parser.parse_args(args)
    a.command_line = list(sys.argv[1:] if args is None else args)
    spark = SparkSession.builder.appName("tablewright").getOrCreate()
    try:
        COMMANDS[a.command][0](spark, a)
    except (ValueError, PySparkException) as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
