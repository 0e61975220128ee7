"""Training sets: prompt and completion rows of the three splits, augmented rows in the training split only."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts

Order = Callable[[Column, Column], Column]
# Figures of a trainer's state that a run records.
TRAIN_METRICS = ("best_metric", "epoch", "global_step")


def completion_rows(items: DataFrame, order: Order = prompts.shuffled, *extra: str) -> DataFrame:
    """(example_id, prompt, completion): the options shuffled by id, the completion is the letter of the answer. ``extra`` columns are passed on."""
    rows = items.withColumn("options", order(prompts.checked(F.col("options")), F.col("example_id")))
    return rows.select(*extra, "example_id", prompts.render(F.col("query"), F.col("options")).alias("prompt"), prompts.letter_of(F.col("options"), F.col("answer_option_id")).alias("completion"))


def augmentation_violations(augmented: DataFrame, train: DataFrame) -> DataFrame:
    """(example_id, violation) of augmented rows (example_id, parent_example_id or null) that must not enter training."""
    ids = train.select("example_id").distinct()
    reused = augmented.select("example_id").join(ids, "example_id", "left_semi").select("example_id", F.lit("id of a training item").alias("violation"))
    orphans = augmented.where("parent_example_id is not null").join(ids.withColumnRenamed("example_id", "parent_example_id"), "parent_example_id", "left_anti")
    return reused.union(orphans.select("example_id", F.lit("parent is not a training item")))


def training_sets(items: DataFrame, manifest: DataFrame, augmented: DataFrame | None = None, order: Order = prompts.shuffled) -> DataFrame:
    """(split, example_id, prompt, completion) of items named by the manifest, and of augmented rows as training rows.

    Check ``augmentation_violations`` first; the splits are written apart by ``partitionBy("split")``.
    """
    needed = ["example_id", "query", "options", "answer_option_id"]
    rows = manifest.select("example_id", "split").join(items.select(*needed), "example_id")
    if augmented is not None:
        rows = rows.unionByName(augmented.select(*needed, F.lit("train").alias("split")))
    return completion_rows(rows, order, "split")


@dataclass(frozen=True)
class Rank:
    """A worker's place among those that train together."""

    number: int
    size: int
    context: BarrierTaskContext

    @property
    def addresses(self) -> list[str]:
        """host:port of every worker's task, by rank; the first is where a process group may meet."""
        return [t.address for t in self.context.getTaskInfos()]

    def wait(self) -> None:
        """Go on when all workers are here."""
        self.context.barrier()

    def gather(self, text: str) -> list[str]:
        """What every worker says, by rank."""
        return self.context.allGather(text)


#: (rank, batches of its rows, folder, model) to a dict with metrics, outputs and metadata, any of which may be missing.
Trainer = Callable[[Rank, Iterator[pa.RecordBatch], str, str], dict]


def train_together(sets: DataFrame, trainer: Trainer, workers: int, folder: str, model: str) -> dict:
    """Run ``trainer`` in ``workers`` tasks that start together, and return the first worker's result, with the rows each worker got.

    A row's worker follows from its example_id alone, and a worker's rows come in order of split and example_id, so every
    attempt and every cluster deals them alike. Rows of one id go to one worker: ids are meant to be unique. If one
    worker is lost all start again, as a barrier stage does; a trainer that wants to go on from where it was keeps
    checkpoints in ``folder``. Rows are streamed once; for further epochs a trainer spools them. The cluster needs
    ``workers`` free slots at once. An empty table is an error.
    """
    if workers < 1:
        raise ValueError("at least one worker is needed")
    if sets.isEmpty():
        raise ValueError("there are no rows to train on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, seen = BarrierTaskContext.get(), 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            for b in batches:
                seen += b.num_rows
                yield b

        rank = Rank(context.partitionId(), workers, context)
        mine = counted()
        result = trainer(rank, mine, folder, model) or {}
        for _ in mine:  # rows that the trainer left count too
            pass
        rank.wait()  # no result before all are done
        yield pa.RecordBatch.from_pydict({"rank": pa.array([rank.number], pa.int32()), "rows": pa.array([seen], pa.int64()), "result": [json.dumps(result)]})

    dealt = sets.repartition(workers, "example_id").sortWithinPartitions("split", "example_id")
    told = dealt.mapInArrow(run, "rank int, rows long, result string", barrier=True)
    found = told.repartition(1).collect()  # a row a worker; Spark restarts a barrier stage only if a shuffle follows it
    found.sort(key=lambda r: r["rank"])
    result = {part: {} for part in ("metrics", "outputs", "metadata")} | json.loads(found[0]["result"])
    result["metadata"] = result["metadata"] | {"rows_by_rank": json.dumps([r["rows"] for r in found])}
    return result


def train_metrics(state: Column) -> Column:
    """Of a trainer's state (variant): the figures in TRAIN_METRICS that are present, as a map."""
    found = [F.struct(F.lit(n).alias("k"), F.try_variant_get(state, f"$.{n}", "double").alias("v")) for n in TRAIN_METRICS]
    return F.map_from_entries(F.filter(F.array(*found), lambda e: e["v"].isNotNull()))
