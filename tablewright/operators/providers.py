"""Calls to a text provider as an expression: one client a task, a failed call is data; calls that resume from a ledger of replies."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A client is made once a task from a factory; it takes a text and returns a text, or an object that becomes JSON.
Client = Callable[[], Callable[[str], object]]
LEDGER = "digest string, reply string, error string, asked_at timestamp"


class GiveUp(Exception):
    """A failure that another attempt cannot mend; the call is not tried again."""


@dataclass(frozen=True)
class Calls:
    """How calls are made.

    attempts: tries of a call before its failure is data. wait: seconds before the second try, doubled for each
    further one up to ``longest``, and shortened by chance to a half at most, so that tasks do not return together.
    ledger: a folder of replies in a store that all machines share; without it nothing is remembered. scope: what
    else a reply depends on, such as the model's name; part of a request's key. per_task: requests a task asks
    before its replies are safe.
    """

    attempts: int = 1
    wait: float = 2.0
    longest: float = 60.0
    ledger: str | None = None
    scope: str = ""
    per_task: int = 500


ONCE = Calls()


def attempt(call: Callable[[str], object], text: str, calls: Calls, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(reply, None), or (None, message of the last failure)."""
    for n in range(1, calls.attempts + 1):
        try:
            got = call(text)
            return (got if isinstance(got, str) else json.dumps(got)), None
        except Exception as e:  # the provider's failure is data here
            error = str(e)
            if n == calls.attempts or isinstance(e, GiveUp):
                break
            sleep(min(calls.longest, calls.wait * 2 ** (n - 1)) * random.uniform(0.5, 1.0))
    return None, error


def replies(payload: Column, client: Client, calls: Calls = ONCE) -> Column:
    """struct(reply, error) for each payload; a null payload is asked as an empty text."""
    if calls.attempts < 1:
        raise ValueError("at least one attempt is needed")

    @F.pandas_udf("reply string, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = client()
        for texts in batches:
            yield pd.DataFrame([attempt(call, text or "", calls) for text in texts], columns=["reply", "error"], dtype=object)

    # marked so that the optimiser neither repeats nor moves the calls
    return ask.asNondeterministic()(payload)


def digest(payload: Column, scope: str = "") -> Column:
    """The key of a request: sha256 of the scope's own digest and the text; null counts as an empty text."""
    return F.sha2(F.concat(F.sha2(F.lit(scope), 256), F.coalesce(payload, F.lit(""))), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(digest, reply, error): one row a request, an answer before a failure, the first answer of several. An absent ledger is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LEDGER).drop("asked_at")
    rows = spark.read.schema(LEDGER).parquet(ledger)
    # the least: answers (false) before failures, then the earliest
    best = rows.groupBy("digest").agg(F.min(F.struct(F.col("error").isNotNull().alias("failed"), "asked_at", "reply", "error")).alias("_r"))
    return best.select("digest", "_r.reply", "_r.error")


def fill_ledger(requests: DataFrame, client: Client, calls: Calls) -> int:
    """Ask each request (digest, payload) that the ledger has no answer to, and add the replies; returns how many were asked.

    Equal requests are asked once. The output committer is the one that publishes a task's file when the task ends, so
    a run that is killed keeps what its finished tasks got (``per_task`` requests each), and the next asks the rest. A
    task that is run twice may leave an answer twice; the ledger's reader takes one. Failures are recorded, and asked again next time.
    """
    spark = requests.sparkSession
    known = read_ledger(spark, calls.ledger).where("error is null").select("digest")
    left = requests.groupBy("digest").agg(F.min("payload").alias("payload")).join(known, "digest", "left_anti")
    n = left.count()
    if n:
        got = left.repartition(-(-n // calls.per_task), "digest").withColumn("_r", replies(F.col("payload"), client, calls))
        rows = got.select("digest", "_r.reply", "_r.error", F.current_timestamp().alias("asked_at"))
        rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(calls.ledger)
    return n


def with_replies(rows: DataFrame, payload: Column, client: Client, calls: Calls = ONCE) -> DataFrame:
    """``rows`` with the columns reply and error.

    Without a ledger every row is asked once, when the frame is read. With one the calls are made now: what the ledger
    answers is not asked, equal requests share a reply, and the frame may be read again; ``rows`` must be the same
    each time they are read. Names of columns that ``rows`` has already are replaced by the new ones.
    """
    others = [F.col(c) for c in rows.columns if c not in ("reply", "error")]
    if calls.ledger is None:
        asked = rows.withColumn("_r", replies(payload, client, calls))
        return asked.select(*others, F.col("_r.reply").alias("reply"), F.col("_r.error").alias("error"))
    fill_ledger(rows.select(digest(payload, calls.scope).alias("digest"), F.coalesce(payload, F.lit("")).alias("payload")), client, calls)
    answers = read_ledger(rows.sparkSession, calls.ledger).select(F.col("digest").alias("_digest"), F.struct("reply", "error").alias("_r"))
    met = rows.withColumn("_digest", digest(payload, calls.scope)).join(answers, "_digest", "left")
    return met.select(*others, F.col("_r.reply").alias("reply"), F.col("_r.error").alias("error"))
