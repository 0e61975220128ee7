"""Tables in the folder all machines share, and settings every operator needs."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where ``store`` notes the tables of the piece of work that is going on, if anyone asked.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of its own only where that is unset and all runs in one process (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "place" not in _own:
        _own["place"] = "file://" + tempfile.mkdtemp(prefix="tablewright-")
    return _own["place"]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder's owner then cleans up
        return


def prepare(spark: SparkSession) -> None:
    """Settings that make row numbers repeatable and Arrow batches small.

    The split of a scan depends on the number of cores registered when it is planned unless a
    minimum is set; with it, row numbers stay the same when executors come and go.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(2, spark.sparkContext.defaultParallelism)))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@contextmanager
def _passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run in the block remove their shuffle files at their end; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def store(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table goes when the driver ends, or with the ``passing_tables`` around it unless it ``stays``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _passing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    if _noted.get() is not None and not stays:
        _noted.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables stored in the block go at its end, also if it fails; those that are to outlive it are stored with ``stays``.

    Blocks may be nested, and threads do not see each other's.
    """
    mine: list[str] = []
    token = _noted.set(mine)
    try:
        yield
    finally:
        _noted.reset(token)
        for path in mine:
            _drop(spark, path)


def drop_table(df: DataFrame) -> None:
    """Remove a stored table that no later plan reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, path)


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Let the cleaner remove shuffle files of plans that a stored table has replaced."""
    gc.collect()
    spark._jvm.System.gc()


def with_uid(docs: DataFrame) -> DataFrame:
    """Number the rows of a table read from files: unique, and the same each time it is read.

    The number is Spark's partition number << 33 plus the row's place in it, as ``task_uid`` gives
    inside mapInArrow. ``docs`` must be a deterministic read (files, not the output of a shuffle).
    """
    return docs.withColumn("uid", F.monotonically_increasing_id())


def spare_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def task_base() -> int:
    """The first row number of this task's partition."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
