"""Writers of the log of runs that come at the same time."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tablewright.operators import runs

FIRST = {"run_id": "r/1", "seq": 0, "run_type": "train", "status": "running", "stage": "candidate", "metadata": {}}


def test_changes_made_at_once_are_all_kept(spark, tmp_path):
    """Each writer changes a field of its own kind; the last event has all changes, and no number is met twice."""
    log = str(tmp_path / "log")
    runs.append(spark, log, FIRST)
    changes = [{"stage": "validated"}, {"status": "completed"}, {"model_name": "m"}, {"finished_at": "t"}]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda c: runs.advance(spark, log, "r/1", c), changes))
    events = runs.read_events(spark, log).collect()
    assert sorted(e.seq for e in events) == [0, 1, 2, 3, 4]
    state = runs.current(runs.read_events(spark, log)).collect()
    assert [(s.stage, s.status, s.model_name, s.finished_at, s.seq) for s in state] == [("validated", "completed", "m", "t", 4)]


def test_one_claim_wins_and_dead_writers_are_passed_over(spark, tmp_path):
    log = str(tmp_path / "log")
    runs.append(spark, log, FIRST)
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda _: runs._claim(spark, log, "r/1", 1), range(24))) == 1  # claimed, and never written
    assert runs.advance(spark, log, "r/1", {"stage": "archived"}, patience=0.5, pause=0.1)["seq"] == 2
    assert runs.current(runs.read_events(spark, log)).first().stage == "archived"
    with pytest.raises(ValueError):
        runs.advance(spark, log, "r/2", {})
    with pytest.raises(ValueError):
        runs.advance(spark, log, "r/1", {"stage": "odd"})
    assert runs.read_events(spark, log).count() == 2


def test_promotion_during_a_run_stays(spark, tmp_path):
    log = str(tmp_path / "log")
    with runs.tracked(spark, log, "train", "m", run_id="r1"):
        runs.promote(spark, log, "r1", "validated")
    state = runs.current(runs.read_events(spark, log)).first()
    assert (state.status, state.stage, state.seq) == ("completed", "validated", 2)
