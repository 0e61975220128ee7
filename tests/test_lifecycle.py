import json

import pytest
from pyspark.sql import functions as F

from tablewright.cli import main
from tablewright.operators import evaluation, generation, runs, training
from tablewright.sources import json_files

TYPES = ("Specific", "Commonsense", "Negated", "Analogical", "Temporal")
ITEM = f"pos long, example_id string, query string, options array<{json_files.OPTION}>, answer_option_id string, query_type_flags {json_files.FLAGS}"


def item(i):
    return (i, f"e{i}", f"a dish of kind {i}", [(f"o{i}-{k}", f"text {k} of {i}") for k in range(5)], f"o{i}-{i % 5}", (i % 2 == 0, i % 3 == 0, False, False, True))


def client():
    """Replies to all four kinds of request, and to prompts."""

    def reply(text):
        if not text.startswith("{"):
            return "Answer: A"
        asked = json.loads(text)
        name = asked["schema_name"]
        if name == "synthetic_query_generation":
            said = asked["parent_example"]["query"]
            return {"candidates": [{"query": f"please {said}", "method_tag": "polite", "rationale": "r", "intended_query_type_target": ""}, {"query": "the same for all"}, {"query": said.upper()}]}
        if name == "synthetic_full_generation":
            said = asked["seed_example"]["query"]
            flags = {t: t == "Temporal" for t in TYPES}
            good = {"query": f"wholly new {said}", "options": ["a", "b", "c", "d", "e"], "answer_index": 3, "query_type_flags": flags, "correctness_explanation": [{"key": "k", "value": "v"}]}
            return {"candidates": [{**good, "options": ["a", "A ", "c", "d", "e"]}, {**good, "answer_index": 5}, {**good, "query_type_flags": {"Specific": True}}, good, good]}
        scores = generation.QUERY_SCORES if name == "synthetic_query_review" else generation.FULL_SCORES
        verdict = {"review_status": "approved", "review_scores": {s: 0.0 if s == "leakage_risk" else 1.0 for s in scores}, "failure_modes": [], "review_summary": " fine "}
        return verdict | ({"distribution_fit_score": 0.9} if name == "synthetic_full_review" else {})

    return reply


def trainer(sets, folder, model):
    return {"metrics": {"epoch": 2, "odd": 1.5}, "outputs": {"final_model_dir": folder}, "metadata": {"rows": sets.count()}}


def broken(sets, folder, model):
    raise ValueError("out of memory")


@pytest.fixture
def items(spark):
    return spark.createDataFrame([item(i) for i in range(20)], ITEM)


@pytest.fixture
def files(items, tmp_path):
    at = lambda name: str(tmp_path / name)
    items.write.json(at("items"))
    ids = [f"e{i}" for i in range(20)]
    (tmp_path / "splits.json").write_text(json.dumps({"metadata": {}, "splits": {"train": ids[:12], "validation": ids[12:16], "test": ids[16:]}}))
    return at


def run(*args):
    return main([str(a) for a in args])


def test_generated_queries(spark, items):
    rows = generation.generate_queries(items, items, client, "m", "t", limit=20).orderBy("pos").collect()
    assert [r.example_id for r in rows[:3]] == ["e0-sq-01", "e0-sq-02", "e1-sq-01"] and len(rows) == 21
    assert rows[0].query == "please a dish of kind 0" and rows[0].generation_method == "polite" and rows[1].generation_method == "query_generation"
    assert rows[0].answer_option_id == "o0-0" and rows[0].intended_query_type_target == "Specific|Commonsense|Temporal" and rows[0].review_status == "pending"
    fails = lambda: lambda text: 1 / 0
    assert generation.generate_queries(items, items, fails, "m", "t", limit=20).count() == 0
    assert generation.generate_queries(items, items, client, "m", "t", limit=5).select("parent_example_id").distinct().count() == 5
    with pytest.raises(ValueError):
        generation.generate_queries(items, items, client, "m", "t", most=0)


def test_generated_items(spark, items):
    rows = generation.generate_full(items, items, client, "m", "t", limit=20).orderBy("pos").collect()
    assert [r.example_id for r in rows] == [f"synfull-{i:04d}" for i in range(1, 21)]
    first = rows[0]
    assert first.answer_option_id == "synfull-0001-opt-4" and first.options[3].text == "d" and first.seed_example_ids == ["e0"] and first.correctness_explanation == {"k": ["v"]}
    assert first.query_type_flags.Temporal and not first.query_type_flags.Specific and first.distractor_generation_method == "template_conditioned_generation"


def test_reviews(spark, items):
    rows = spark.createDataFrame(generation.generate_queries(items, items, client, "m", "t", limit=2).collect(), generation.generate_queries(items, items, client, "m", "t", limit=2).schema)
    good = generation.review(rows, items, client, "r", "later").collect()
    assert {r.review_status for r in good} == {"approved"} and good[0].review_scores["answer_preservation"] == 1.0 and good[0].review_summary == "fine"
    fails = generation.review(rows, items, lambda: lambda text: 1 / 0, "r", "later").collect()
    assert {(r.review_status, r.review_summary) for r in fails} == {("pending", "no review: division by zero")}
    odd = generation.review(rows, items, generation.fake_client({"synthetic_query_review": {"review_status": "maybe"}}), "r", "later").collect()
    assert {(r.review_status, r.review_summary) for r in odd} == {("pending", "no review: malformed reply")}
    with pytest.raises(ValueError):
        generation.review(rows.withColumn("parent_example_id", F.lit("nobody")), items, client, "r", "later")


def test_reply_schemas():
    for name in generation.REPLIES:
        schema = generation.reply_schema(name, 3)
        assert schema["additionalProperties"] is False and schema["required"] == list(schema["properties"])
    query = generation.reply_schema("synthetic_query_generation", 3)["properties"]["candidates"]
    assert query["maxItems"] == 3 and query["items"]["properties"]["query"] == {"type": "string", "minLength": 1}
    full = generation.reply_schema("synthetic_full_generation")["properties"]["candidates"]["items"]["properties"]
    assert full["options"]["minItems"] == full["options"]["maxItems"] == 5 and full["answer_index"]["maximum"] == 4 and set(full["query_type_flags"]["properties"]) == set(TYPES)
    review = generation.reply_schema("synthetic_query_review")["properties"]
    assert review["review_status"]["enum"] == ["approved", "rejected"] and review["review_scores"]["properties"]["leakage_risk"] == {"type": "number", "minimum": 0, "maximum": 1}


def test_evaluation(spark, items):
    rows = items.withColumnRenamed("query_type_flags", "flags")

    def flaky():
        return lambda prompt: 1 / 0 if "kind 3\n" in prompt else "Answer: B"

    got = evaluation.evaluate(rows, flaky, limit=6).orderBy("pos").collect()
    assert len(got) == 6 and got[3].parse_failure and got[3].raw_response == "" and got[3].error == "division by zero" and not got[3].is_correct
    assert all(r.predicted_letter == "B" and r.is_correct == (r.correct_letter == "B") and (r.options is None) == r.is_correct for r in got if r.pos != 3)
    scores = lambda: lambda prompt: {"A": 0.1, "B": 0.7, "C": 0.7}
    likely = evaluation.evaluate(rows, scores, "loglikelihood").collect()
    assert {(r.predicted_letter, r.raw_response) for r in likely} == {("B", "[loglikelihood] selected B")}
    none = evaluation.summary(evaluation.evaluate(rows.limit(0), flaky), "m", "test").first().asDict(recursive=True)
    assert none["metrics"]["total"] == 0 and none["metrics"]["overall"] == 0
    assert "Overall:         0.0% (0/0)" in evaluation.report(none)
    with pytest.raises(ValueError):
        evaluation.evaluate(rows, flaky, "guess")


def test_leaderboard(spark):
    docs = [("a/b:c", "test", '{"total": 4, "total_correct": 3, "parse_failures": 1}'), ("tuned", "test", '{"total": 4, "total_correct": 1}'), ("x", "test", '{"total": 0, "total_correct": 0}')]
    results = spark.createDataFrame(docs, "model string, split string, m string").withColumn("metrics", F.parse_json("m"))
    bases = spark.createDataFrame([("tuned", "org/base-1")], "model string, base string")
    got = {r["name"]: (r.correct, r.percent, r.parse_failures) for r in evaluation.leaderboard(results, bases).collect()}
    assert got == {"a_b_c": (3, 75.0, 1), "base-1_finetuned": (1, 25.0, 0), "x": (0, 0.0, 0)}
    assert evaluation.leaderboard(results, bases, only=["x", "a_b_c"], exclude=["x"]).count() == 1
    assert evaluation.bar_chart([("a<b", 50.0)], "t").count("<rect") == 1


def test_training_sets(spark, items):
    manifest = items.select(F.when(F.col("pos") < 15, "train").otherwise("test").alias("split"), "pos", "example_id")
    more = items.where("pos < 2").select(F.concat("example_id", F.lit("-x")).alias("example_id"), F.col("example_id").alias("parent_example_id"), "query", "options", "answer_option_id")
    sets = training.training_sets(items, manifest, more)
    assert {r.split: r["count"] for r in sets.groupBy("split").count().collect()} == {"train": 17, "test": 5}
    assert all(f"{r.completion}) text" in r.prompt for r in sets.collect())
    train = manifest.where("split = 'train'")
    assert training.augmentation_violations(more, train).count() == 0
    bad = more.withColumn("parent_example_id", F.lit("e19")).unionByName(items.where("pos = 1").select("example_id", F.lit(None).cast("string").alias("parent_example_id"), "query", "options", "answer_option_id"))
    assert sorted(r.violation for r in training.augmentation_violations(bad, train).collect()) == ["id of a training item", "parent is not a training item", "parent is not a training item"]
    state = spark.sql("select parse_json('{\"epoch\": 3, \"log\": []}') s")
    assert state.select(training.train_metrics(F.col("s")).alias("m")).first().m == {"epoch": 3.0}


def test_tracked_runs(spark, tmp_path):
    log, (times) = str(tmp_path / "log"), iter(f"t{i}" for i in range(20))
    (tmp_path / "f").write_text("abc")
    clock = lambda: next(times)
    with runs.tracked(spark, log, "train", "m", run_id="r1", inputs={"f": str(tmp_path / "f"), "no": str(tmp_path / "no")}, clock=clock) as r:
        assert runs.current(runs.read_events(spark, log)).first().status == "running"
        r["metrics"], r["outputs"] = {"epoch": 1, "odd": 2}, {"final_model_dir": str(tmp_path)}
    with pytest.raises(RuntimeError), runs.tracked(spark, log, "eval", "m", run_id="r2", parent="r1", clock=clock):
        raise RuntimeError("lost")
    runs.promote(spark, log, "r1", "validated", clock)
    state = {r.run_id: r for r in runs.current(runs.read_events(spark, log)).collect()}
    assert (state["r1"].status, state["r1"].stage, state["r1"].created_at, state["r1"].finished_at) == ("completed", "validated", "t0", "t1")
    assert (state["r2"].status, state["r2"].metadata, state["r2"].parent_run_id) == ("failed", {"error": "lost"}, "r1")
    assert [(a.artifact_type, a.size_bytes) for a in state["r1"].input_artifacts] == [("file", 3), ("missing", None)]
    current = runs.current(runs.read_events(spark, log))
    entry = runs.models(current).collect()
    assert len(entry) == 1 and entry[0].artifact_path == str(tmp_path) and entry[0].metrics == {"epoch": 1.0}
    assert runs.parent_model(current, "r1") == str(tmp_path)
    for wrong in (lambda: runs.parent_model(current, "r2"), lambda: runs.promote(spark, log, "r9", "validated"), lambda: runs.promote(spark, log, "r1", "odd")):
        with pytest.raises(ValueError):
            wrong()
    assert runs.read_events(spark, str(tmp_path / "absent")).count() == 0


def test_synthetic_commands(spark, files, capsys):
    at, me = files, "tests.test_lifecycle:client"
    data = ["--dataset", at("items"), "--splits", at("splits.json")]
    for kind, n in (("query", 13), ("full", 12)):
        assert run(f"generate-synthetic-{kind}", *data, "--client", me, "--model", "m", "--output", at(f"{kind}1")) == 0
        assert spark.read.json(at(f"{kind}1")).count() == n
        assert run(f"approve-synthetic-{kind}", "--input", at(f"{kind}1"), *data, "--approval-batch-id", "b", "--output", at(f"{kind}0")) == 0
        assert f"review_not_approved\t{n}" in capsys.readouterr().out
        assert run(f"review-synthetic-{kind}", "--input", at(f"{kind}1"), "--dataset", at("items"), "--client", me, "--model", "r", "--output", at(f"{kind}2")) == 0
        assert run(f"approve-synthetic-{kind}", "--input", at(f"{kind}2"), *data, "--approval-batch-id", "b", "--output", at(f"{kind}3")) == 0
        rows = spark.read.json(at(f"{kind}3")).collect()
        assert len(rows) == n and {r.approval_batch_id for r in rows} == {"b"}
    both = ["--query-approved", at("query3"), "--full-approved", at("full3")]
    assert run("build-synthetic-train", *data, *both, "--target-ratio", 0.5, "--full-share", 0.5, "--output", at("more"), "--summary-output", at("summary")) == 0
    summary = json.loads("\n".join(r[0] for r in spark.read.text(at("summary")).collect()))
    assert summary == {"synthetic_query_count": 3, "synthetic_full_count": 3, "total_synthetic_count": 6, "train_example_count": 12, "target_ratio": 0.5, "full_share": 0.5, "output_path": at("more")}
    assert capsys.readouterr().out.split()[-4:] == ["full", "3", "query", "3"]
    assert run("build-synthetic-train", *data, *both, "--target-ratio", 0.5, "--max-full-examples", 1, "--output", at("x")) == 1
    assert run("build-synthetic-train", *data, "--query-approved", at("query1"), "--output", at("x")) == 1
    assert "review status must be approved" in capsys.readouterr().err


def test_run_commands(spark, files, capsys):
    at, me = files, "tests.test_lifecycle"
    data = ["--dataset", at("items"), "--splits", at("splits.json"), "--registry", at("log"), "--model", "m"]
    assert run("run-train", *data, "--output", at("out"), "--trainer", f"{me}:trainer") == 0
    assert {r.split: r["count"] for r in spark.read.json(at("out/sets")).groupBy("split").count().collect()} == {"train": 12, "validation": 4, "test": 4}
    assert run("run-train", *data, "--output", at("out2"), "--trainer", f"{me}:broken") == 1
    assert run("run-eval", *data, "--output", at("eval"), "--client", f"{me}:client", "--limit", 3) == 0
    assert "(mode=generative)" in capsys.readouterr().out
    assert spark.read.json(at("eval/rows")).count() == 3 and spark.read.json(at("eval/summary")).first().metrics.total == 3
    state = runs.current(runs.read_events(spark, at("log"))).collect()
    assert sorted((r.run_type, r.status) for r in state) == [("eval", "completed"), ("train", "completed"), ("train", "failed")]
    done = next(r for r in state if r.run_type == "eval")
    assert done.metrics["total"] == 3.0 and done.command[0] == "run-eval" and run("promote-run", "--registry", at("log"), "--run-id", done.run_id, "--stage", "validated") == 0
    assert run("list-runs", "--registry", at("log"), "--stage", "validated") == 0
    assert done.run_id in capsys.readouterr().out
    document = json.loads("\n".join(r[0] for r in spark.read.text(at("eval/result.json")).collect()))
    assert document["metrics"]["total"] == 3 and [r["index"] for r in document["results"]] == sorted(r["index"] for r in document["results"]) and len(document["results"]) == 3
    for r in document["results"]:
        assert r["query"] and r["correct_answer_id"] and (len(r.get("options", {})) == 0 if r["is_correct"] else len(r["options"]) == 5)
    assert json_files.read_results(spark, at("eval/result.json")).first().model == "m"
    trained = next(r for r in state if r.run_type == "train" and r.status == "completed")
    data = [*data[:-2]]
    assert run("run-eval", *data, "--output", at("eval2"), "--client", f"{me}:client", "--limit", 2, "--parent-run-id", trained.run_id) == 0
    child = next(r for r in runs.current(runs.read_events(spark, at("log"))).collect() if r.parent_run_id)
    assert child.model_name == runs.parent_model(runs.current(runs.read_events(spark, at("log"))), trained.run_id)
    assert run("run-eval", *data, "--output", at("eval3"), "--client", f"{me}:client") == 1
    assert run("run-eval", *data, "--output", at("eval3"), "--client", f"{me}:client", "--parent-run-id", done.run_id) == 1
    capsys.readouterr()
    assert run("compare-runs", "--registry", at("log"), "--run-id", done.run_id) == 0 and "overall" in capsys.readouterr().out


def test_listed_document_in_parts(spark, tmp_path):
    """Rows in many files and any order become one list in order; no rows an empty one; a document is replaced."""
    head = spark.createDataFrame([("m \"1\"", None)], "model string, note string")
    rows = spark.range(1000).select((999 - F.col("id")).alias("index"), F.when(F.col("id") % 2 == 0, F.lit("a\nb")).alias("text")).repartition(9)
    path = str(tmp_path / "d.json")
    for n in (1000, 1, 0):
        json_files.write_listed(head, "results", rows.where(F.col("index") < n), "index", path)
        got = json.loads(open(path).read())
        assert got == {"model": "m \"1\"", "note": None, "results": [{"index": i, "text": "a\nb"} if i % 2 else {"index": i} for i in range(n)]}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["d.json"]
