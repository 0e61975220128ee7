"""Calls to a provider: attempts, and runs that resume from a ledger."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import evaluation, providers
from tablewright.operators.providers import Calls, GiveUp


def recording(path, bad=lambda text: None):
    """A client that notes each call in a file; ``bad`` may raise."""

    def factory():
        def reply(text):
            with open(path, "a") as f:
                f.write(text + "\n")
            bad(text)
            return f"re {text}"

        return reply

    return factory


def asked(path):
    try:
        return sorted(open(path).read().split("\n")[:-1])
    except FileNotFoundError:
        return []


def test_attempts_wait_longer_each_time(spark):
    slept, left = [], [ValueError("1"), ValueError("2"), None]

    def call(text):
        error = left.pop(0)
        if error:
            raise error
        return {"said": text}

    assert providers.attempt(call, "x", Calls(attempts=3, wait=4.0), slept.append) == ('{"said": "x"}', None)
    assert 2 <= slept[0] <= 4 <= slept[1] <= 8
    left[:] = [ValueError("1"), ValueError("2"), None]
    assert providers.attempt(call, "x", Calls(attempts=2), slept.append) == (None, "2")
    left[:] = [GiveUp("never"), None]
    assert providers.attempt(call, "x", Calls(attempts=5), slept.append) == (None, "never") and len(left) == 1
    slept.clear()
    providers.attempt(lambda t: 1 / 0, "x", Calls(attempts=9, longest=5.0), slept.append)
    assert len(slept) == 8 and max(slept) <= 5
    with pytest.raises(ValueError):
        providers.replies(F.lit("x"), lambda: str, Calls(attempts=0))


def test_ledger_is_asked_first(spark, tmp_path):
    """Equal requests are asked once, answers are kept, failures asked again, and another scope is another request."""
    calls, notes = Calls(ledger=str(tmp_path / "ledger"), scope="m", per_task=2), str(tmp_path / "notes")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "c")], "id long, text string").withColumn("reply", F.lit("old"))

    def fails(text):
        if text == "b":
            raise ValueError("busy")

    first = providers.with_replies(rows, F.col("text"), recording(notes, fails), calls)
    assert first.columns == ["id", "text", "reply", "error"]
    want = {1: ("re a", None), 2: (None, "busy"), 3: ("re a", None), 4: ("re ", None), 5: ("re ", None), 6: ("re c", None)}
    for _ in range(2):  # reading again asks nobody
        assert {r.id: (r.reply, r.error) for r in first.collect()} == want
    assert asked(notes) == ["", "a", "b", "c"]
    second = providers.with_replies(rows, F.col("text"), recording(notes), calls)
    assert {r.id: r.reply for r in second.collect()} == {k: v[0] for k, v in want.items()} | {2: "re b"} and asked(notes) == ["", "a", "b", "b", "c"]
    requests = rows.select(providers.digest(F.col("text"), "other").alias("digest"), F.col("text").alias("payload"))
    assert providers.fill_ledger(requests, recording(notes), calls) == 4
    assert providers.fill_ledger(requests, recording(notes), calls) == 0
    assert providers.with_replies(rows.limit(0), F.col("text"), recording(notes), calls).collect() == []
    assert providers.read_ledger(spark, str(tmp_path / "absent")).collect() == []


def test_killed_run_keeps_what_finished_tasks_got(spark, tmp_path):
    calls, one, two = Calls(ledger=str(tmp_path / "ledger"), per_task=5), str(tmp_path / "one"), str(tmp_path / "two")
    rows = spark.range(400).select(F.concat(F.lit("q"), "id").alias("text"))

    def dies(text):
        if text == "q17":
            import time

            time.sleep(3)  # tasks beside it end first
            raise SystemExit("the machine is lost")  # no failure of the provider, so the task fails

    with pytest.raises(Exception):
        providers.with_replies(rows, F.col("text"), recording(one, dies), calls)
    safe = {r.reply for r in spark.read.parquet(calls.ledger).collect()}
    assert 100 < len(safe) < 400
    got = providers.with_replies(rows, F.col("text"), recording(two), calls).collect()
    assert {r.reply for r in got} == {f"re q{i}" for i in range(400)} and len(got) == 400
    assert {f"re {t}" for t in asked(two)} == {f"re q{i}" for i in range(400)} - safe  # only what was left


def test_evaluation_resumes(spark, tmp_path):
    options = [(f"o{k}", f"text {k}") for k in range(5)]
    items = spark.createDataFrame([(i, f"e{i}", f"query {i}", options, "o1", (True, False, False, False, False)) for i in range(30)],
                                  "pos long, example_id string, query string, options array<struct<option_id:string,text:string>>, answer_option_id string, flags struct<Specific:boolean,Commonsense:boolean,Negated:boolean,Analogical:boolean,Temporal:boolean>")
    calls, notes = Calls(attempts=2, wait=0.0, ledger=str(tmp_path / "ledger"), scope="m"), str(tmp_path / "notes")
    short = evaluation.evaluate(items, lambda: lambda p: "Answer: B", limit=12, calls=calls)
    assert short.count() == 12
    rows = evaluation.evaluate(items, lambda: lambda p: open(notes, "a").write("x\n") and "Answer: B", calls=calls)
    assert rows.where("predicted_letter = 'B'").count() == 30 and len(asked(notes)) == 18
    assert evaluation.summary(rows, "m", "test").first().metrics.total == 30 and len(asked(notes)) == 18
