"""Tracked runs: an append-only log of events; the state of a run is its latest event.

Nothing is overwritten, so two drivers may append at once and a reader never meets a half-written table. A change of
a run builds on its latest event: a writer claims the next number of the run first, and one that comes second reads again.
"""

from __future__ import annotations

import hashlib
import platform
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import RUN_STATUSES, RUN_TYPES, STAGES, latest, metric_summary, primary_artifact

ARTIFACT = "struct<name:string,path:string,artifact_type:string,exists:boolean,sha256:string,size_bytes:bigint>"
EVENT = (
    f"run_id string, seq bigint, run_type string, status string, stage string, created_at string, finished_at string, updated_at string, model_name string, parent_run_id string, "
    f"command array<string>, environment map<string,string>, input_artifacts array<{ARTIFACT}>, output_artifacts array<{ARTIFACT}>, metrics map<string,double>, metadata map<string,string>"
)

MANIFEST = (
    f"schema_version string, run_id string, run_type string, status string, created_at string, finished_at string, entrypoint string, command array<string>, git_commit string, git_dirty boolean, environment variant, "
    f"input_artifacts array<{ARTIFACT}>, output_artifacts array<{ARTIFACT}>, model variant, prompt variant, metrics variant, parent_run_id string, metadata variant"
)


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _checked(event: dict) -> dict:
    for name, allowed in (("run_type", RUN_TYPES), ("status", RUN_STATUSES), ("stage", STAGES)):
        if event.get(name) not in allowed:
            raise ValueError(f"unknown {name}: {event.get(name)}")
    return event


def append(spark: SparkSession, log: str, event: dict) -> dict:
    """One event more. The event's other fields are null."""
    row = spark.createDataFrame([_checked(event)], EVENT)
    row.coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(log)
    return event


def read_events(spark: SparkSession, log: str) -> DataFrame:
    """All events; a log that does not exist is empty. An event without a number is a run's first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(EVENT).json(log, mode="FAILFAST").withColumn("seq", F.coalesce("seq", F.lit(0)))


def _claim(spark: SparkSession, log: str, run_id: str, seq: int) -> bool:
    """Whether this writer is the one that may write event ``seq`` of the run: a file that only one can create."""
    name = f"{hashlib.sha256(run_id.encode()).hexdigest()}-{seq}"  # readers pass over folders that begin with _
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/_claims/{name}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where.getParent())
    if files.getUri().getScheme() == "file":  # the local file system's own call looks first and creates then
        return spark._jvm.java.io.File(files.makeQualified(where).toUri().getPath()).createNewFile()
    return files.createNewFile(where)


def advance(spark: SparkSession, log: str, run_id: str, change: dict, patience: float = 60.0, pause: float = 0.2) -> dict:
    """One event more of a run: its latest with ``change``; returns it.

    If another writer has claimed the next number, its event is waited for and built upon, so of changes made at once
    none is lost. A writer that claimed a number and is not heard of for ``patience`` seconds is taken for dead, and its
    number is passed over. An unknown run is an error.
    """
    passed, since = -1, time.monotonic()
    while True:
        found = current(read_events(spark, log).where(F.col("run_id") == run_id)).head(1)  # one row
        if not found:
            raise ValueError(f"no run {run_id}")
        latest_one = found[0].asDict(recursive=True)
        seq = max(latest_one["seq"], passed) + 1
        event = _checked(latest_one | change | {"seq": seq})
        if _claim(spark, log, run_id, seq):
            return append(spark, log, event)
        if time.monotonic() - since > patience:
            passed, since = seq, time.monotonic()
        else:
            time.sleep(pause)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of a folder, ``root``/runs/<run>/run_manifest.json, in order of their paths; without any the table is empty."""
    pattern = f"{root}/runs/*/run_manifest.json"
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    if not len(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(pattern, multiLine=True, mode="FAILFAST").orderBy(F.col("_metadata.file_path"))


def current(events: DataFrame) -> DataFrame:
    """One row a run: its latest event, by partial maxima of the sequence number and then by a join."""
    top = latest(events.select("run_id", "seq"), "run_id", ["seq"])
    return events.join(top, ["run_id", "seq"], "left_semi").dropDuplicates(["run_id"])


def entries(runs: DataFrame) -> DataFrame:
    """Registry rows of runs: the main artifact, and the figures that summaries carry."""
    return runs.select(
        F.col("run_id").alias("entry_id"), "run_id", "run_type", "stage", "status", "model_name", "created_at", "updated_at", "parent_run_id",
        primary_artifact(F.col("output_artifacts")).alias("artifact_path"), metric_summary(F.col("metrics")).alias("metrics"), "metadata")


def models(runs: DataFrame) -> DataFrame:
    """The registry of models: runs that train."""
    return entries(runs.where("run_type = 'train'"))


def artifact_refs(spark: SparkSession, paths: dict[str, str]) -> list[dict]:
    """References to files and folders (name to path): kind, size and, of a file, the sha256."""
    out = []
    for name, path in paths.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        ref = {"name": name, "path": path, "artifact_type": "missing", "exists": files.exists(where), "sha256": None, "size_bytes": None}
        if ref["exists"] and files.getFileStatus(where).isDirectory():
            ref |= {"artifact_type": "dir", "size_bytes": files.getContentSummary(where).getLength()}
        elif ref["exists"]:
            stream = files.open(where)  # digested as a stream, whatever its size
            digest = spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
            stream.close()
            ref |= {"artifact_type": "file", "sha256": digest, "size_bytes": files.getFileStatus(where).getLen()}
        out.append(ref)
    return out


@contextmanager
def tracked(spark: SparkSession, log: str, run_type: str, model: str, stage: str = "candidate", parent: str | None = None, command: list[str] | None = None,
            inputs: dict[str, str] | None = None, run_id: str | None = None, clock: Callable[[], str] = now) -> Iterator[dict]:
    """running, then completed or failed: an event each. The body fills ``metrics``, ``outputs`` (name to path) and ``metadata``.

    A failure is recorded with its message and raised again.
    """
    begun, result = clock(), {"metrics": {}, "outputs": {}, "metadata": {}}
    run = {
        "run_id": run_id or f"{run_type}-{uuid.uuid4().hex[:12]}", "seq": 0, "run_type": run_type, "status": "running", "stage": stage, "created_at": begun, "updated_at": begun,
        "model_name": model, "parent_run_id": parent, "command": list(command or []), "environment": {"python": platform.python_version(), "spark": spark.version},
        "input_artifacts": artifact_refs(spark, inputs or {}), "output_artifacts": [], "metrics": {}, "metadata": {}}
    append(spark, log, run)
    result["run_id"] = run["run_id"]

    def close(status: str, **more: str) -> None:
        at = clock()
        metadata = {k: str(v) for k, v in result["metadata"].items()} | more
        advance(spark, log, run["run_id"], {"status": status, "finished_at": at, "updated_at": at, "output_artifacts": artifact_refs(spark, result["outputs"]), "metrics": {k: float(v) for k, v in result["metrics"].items()}, "metadata": metadata})

    try:
        yield result
    except Exception as e:
        close("failed", error=str(e))
        raise
    close("completed")


def promote(spark: SparkSession, log: str, run_id: str, stage: str, clock: Callable[[], str] = now) -> None:
    """A new stage for a run, as one event more; an unknown run or stage is an error."""
    advance(spark, log, run_id, {"stage": stage, "updated_at": clock()})


def parent_model(runs: DataFrame, run_id: str) -> str:
    """Where the model of a training run is; an error where there is none."""
    rows = runs.where((F.col("run_id") == run_id) & (F.col("run_type") == "train"))
    found = rows.select(F.explode("output_artifacts").alias("a")).where("a.name = 'final_model_dir'").select("a.path").head(1)
    if not found:
        raise ValueError(f"run {run_id} has no final model")
    return found[0][0]
