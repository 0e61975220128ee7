"""Trainers that run in several tasks at once."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import training


@pytest.fixture
def sets(spark):
    rows = spark.range(500).select(F.format_string("e%03d", "id").alias("example_id"), (F.col("id") % 10).cast("string").alias("prompt"), (F.col("id") % 10 * 3 + 1).cast("string").alias("completion"), F.lit("train").alias("split"))
    return rows.repartition(7)


def line(rank, batches, folder, model):
    """Least squares by steps, gradients summed over all workers; notes the ids it saw."""
    rows = [r for b in batches for r in b.to_pylist()]
    with open(f"{folder}/seen-{rank.number}", "a") as f:
        f.write(json.dumps([r["example_id"] for r in rows]) + "\n")
    x = np.array([[float(r["prompt"]), 1.0] for r in rows]).reshape(-1, 2)
    y = np.array([float(r["completion"]) for r in rows])
    w = np.zeros(2)
    for _ in range(60):
        told = [json.loads(t) for t in rank.gather(json.dumps([(x.T @ x).tolist(), (x.T @ (y - x @ w)).tolist()]))]
        w = w + np.linalg.solve(sum(np.array(t[0]) for t in told), sum(np.array(t[1]) for t in told))
        if len(told) != rank.size or len(rank.addresses) != rank.size:
            raise ValueError("a worker is missing")
        break
    return {"metrics": {"slope": float(w[0]), "offset": float(w[1])}, "outputs": {"final_model_dir": folder}, "metadata": {"model": model}}


def lost(rank, batches, folder, model):
    """The third worker dies once, after it has seen its rows."""
    ids = [r for b in batches for r in b.column("example_id").to_pylist()]
    with open(f"{folder}/try-{rank.number}", "a") as f:
        f.write(json.dumps(ids) + "\n")
    rank.wait()
    if rank.number == 2 and not os.path.exists(f"{folder}/died"):
        open(f"{folder}/died", "w").close()
        raise RuntimeError("worker lost")
    rank.wait()
    return {}


def test_each_row_is_seen_once(spark, sets, tmp_path):
    got = training.train_together(sets, line, 4, str(tmp_path), "m")
    assert abs(got["metrics"]["slope"] - 3) < 1e-9 and abs(got["metrics"]["offset"] - 1) < 1e-9 and got["outputs"] == {"final_model_dir": str(tmp_path)}
    seen = [json.loads((tmp_path / f"seen-{i}").read_text().splitlines()[-1]) for i in range(4)]
    assert sorted(x for s in seen for x in s) == [f"e{i:03d}" for i in range(500)] and all(s == sorted(s) for s in seen)
    assert json.loads(got["metadata"]["rows_by_rank"]) == [len(s) for s in seen] and got["metadata"]["model"] == "m"
    training.train_together(sets.repartition(3), line, 4, str(tmp_path), "m")  # dealt alike, however the table is cut
    assert [json.loads((tmp_path / f"seen-{i}").read_text().splitlines()[-1]) for i in range(4)] == seen


def test_lost_worker_restarts_all(spark, sets, tmp_path):
    got = training.train_together(sets, lost, 3, str(tmp_path), "m")
    for i in range(3):
        tries = (tmp_path / f"try-{i}").read_text().splitlines()
        assert len(tries) == 2 and tries[0] == tries[1]
    assert sum(json.loads(got["metadata"]["rows_by_rank"])) == 500


def test_no_rows_and_wrong_numbers(spark, sets, tmp_path):
    for rows, workers in ((sets.limit(0), 2), (sets, 0)):
        with pytest.raises(ValueError):
            training.train_together(rows, line, workers, str(tmp_path), "m")
    got = training.train_together(sets.limit(1), lambda rank, batches, folder, model: None, 2, str(tmp_path), "m")  # a worker without rows; rows left unread
    assert got["metrics"] == {} and sorted(json.loads(got["metadata"]["rows_by_rank"])) == [0, 1]
