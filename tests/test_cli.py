import json

from tablewright.cli import main
from tablewright.sources.json_files import REGISTRY, read_lines

TYPES = ("Specific", "Commonsense", "Negated", "Analogical", "Temporal")


def test_commands_from_raw_file_to_splits(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    record = lambda i: {"query": f"I want to make dish {i} but not nuts", "query_type": {t: int(i % (j + 2) == 0) for j, t in enumerate(TYPES)}, "options": {f"o{i}-{k}": f"t{k}" for k in range(5)}, "answer": f"o{i}-0", "correctness_explanation": {"a": "b", "c": ["d"]}}
    (tmp_path / "raw.json").write_text(json.dumps([record(i) for i in range(40)]))
    assert main(["prepare-data", "--input", at("raw.json"), "--output", at("items"), "--split-output", at("splits")]) == 0
    sizes = {r.split: r["count"] for r in spark.read.json(at("splits")).groupBy("split").count().collect()}
    assert sizes == {"train": 28, "validation": 6, "test": 6}
    assert main(["export-split", "--dataset", at("items"), "--splits", at("splits"), "--split", "test", "--output", at("test")]) == 0
    assert spark.read.json(at("test")).count() == 6
    assert main(["augment-train", "--dataset", at("items"), "--splits", at("splits"), "--output", at("more")]) == 0
    more = [json.loads(r[0]) for r in spark.read.text(at("more")).collect()]
    parents = {r["example_id"]: r for r in (json.loads(x[0]) for x in spark.read.text(at("items")).collect())}
    assert len(more) == 56
    for row in more:
        parent, metadata = parents[row["parent_example_id"]], row["source_metadata"]
        assert (row["query_type_flags"], row["correctness_explanation"], row["options"]) == (parent["query_type_flags"], parent["correctness_explanation"], parent["options"])
        assert metadata == {**parent["source_metadata"], "parent_example_id": row["parent_example_id"], "augmentation_strategy": row["strategy"], "variant_index": row["variant_index"]}
    assert main(["validate-data", "--input", at("more"), "--kind", "prepared"]) == 0
    capsys.readouterr()
    assert main(["dataset-stats", "--input", at("items")]) == 0
    prepared = capsys.readouterr().out
    assert "items\tall\t40" in prepared and "flag\tSpecific\t20" in prepared
    assert main(["dataset-stats", "--input", at("raw.json"), "--kind", "raw"]) == 0
    assert capsys.readouterr().out == prepared
    assert main(["validate-data", "--input", at("items"), "--kind", "prepared"]) == 0 and main(["validate-data", "--input", at("items"), "--kind", "odd"]) == 1
    first = json.loads(spark.read.text(at("items")).first()[0])
    assert first["correctness_explanation"] == {"a": "b", "c": ["d"]} and first["source_metadata"]["raw_index"] == 0
    assert main(["prepare-data", "--input", at("raw.json"), "--output", at("items2"), "--split-output", at("splits.json")]) == 0
    made = json.loads("\n".join(r[0] for r in spark.read.text(at("splits.json")).collect()))
    assert made["metadata"]["counts"] == {"train": 28, "validation": 6, "test": 6} and len(made["splits"]["test"]) == 6
    assert main(["export-split", "--dataset", at("items"), "--splits", at("splits.json"), "--split", "test", "--output", at("test2")]) == 0
    assert sorted(r.example_id for r in spark.read.json(at("test2")).collect()) == sorted(made["splits"]["test"]) == sorted(r.example_id for r in spark.read.json(at("test")).collect())
    (tmp_path / "bad.json").write_text(json.dumps([record(0), {**record(1), "answer": "x"}]))
    assert main(["validate-data", "--input", at("bad.json")]) == 1
    assert "raw record 1: answer must match" in capsys.readouterr().err


def test_commands_of_the_registry(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    row = lambda r, stage: {"entry_id": r, "run_id": r, "run_type": "eval", "stage": stage, "status": "completed", "model_name": "m", "created_at": r}
    (tmp_path / "registry.json").write_text("\n".join(json.dumps(row(*x)) for x in (("r1", "baseline"), ("r2", "candidate"))))
    assert main(["list-runs", "--registry", at("registry.json"), "--stage", "candidate"]) == 0
    out = capsys.readouterr().out
    assert "r2" in out and "r1" not in out
    assert main(["compare-runs", "--registry", at("registry.json"), "--run-id", "r2", "--run-id", "r1"]) == 0
    out = capsys.readouterr().out
    assert out.index("r2") < out.index("r1")
    assert main(["compare-runs", "--registry", at("registry.json"), "--run-id", "r9"]) == 1
    capsys.readouterr()
    assert main(["compare-runs", "--registry", at("registry.json"), "--run-id", "r2", "--format", "json", "--output", at("report.json")]) == 0
    told = json.loads(capsys.readouterr().out)
    assert [r["run_id"] for r in told] == ["r2"] and told == json.loads("\n".join(r[0] for r in spark.read.text(at("report.json")).collect()))
    for name, percent in (("m1", 1), ("m2", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"model": name, "split": "test", "metrics": {"overall": percent / 4, "total_correct": percent, "total": 4}}))
    assert main(["plot-results", "--input", at("m*.json"), "--input", at("absent.json"), "--exclude", "m2", "--output", at("chart.svg")]) == 0
    assert "m1" in capsys.readouterr().out and "<svg" in spark.read.text(at("chart.svg"), wholetext=True).first()[0]
    assert main(["promote-run", "--registry", at("registry.json"), "--run-id", "r1", "--stage", "validated", "--output", at("now")]) == 0
    assert read_lines(spark, at("now"), REGISTRY).where("stage = 'validated'").count() == 1
    assert main(["promote-run", "--registry", at("registry.json"), "--run-id", "r1", "--stage", "odd", "--output", at("x")]) == 1
