"""Scores of parsed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .items import TYPES


def result_rows(df: DataFrame, *extra: str) -> DataFrame:
    """Scored rows from (example_id, letter, letters map, answer_option_id, raw_response, flags, option_texts map).

    An unparsed or unknown letter is wrong; line breaks in the response become spaces; the options are
    kept only where the answer is wrong. ``extra`` columns are passed on.
    """
    chosen = F.try_element_at("letters", F.col("letter"))
    gold = F.coalesce(F.get(F.map_keys(F.map_filter("letters", lambda k, v: v == F.col("answer_option_id"))), F.lit(0)), F.lit("?"))
    correct = F.coalesce(chosen == F.col("answer_option_id"), F.lit(False))
    return df.select(*extra, "example_id", chosen.alias("predicted_id"), F.col("letter").alias("predicted_letter"), gold.alias("correct_letter"), correct.alias("is_correct"),
                     F.col("letter").isNull().alias("parse_failure"), strip(F.replace("raw_response", F.lit("\n"), F.lit(" "))).alias("raw_response"),
                     F.when(~correct, F.col("option_texts")).alias("options"), "flags")


def accuracy(rows: DataFrame) -> DataFrame:
    """(name, total, correct, parse_failures, accuracy) overall and for each type; one pass, types may overlap; no rows give zeros."""
    sums = [F.count("*").alias("overall_n"), F.count_if("is_correct").alias("overall_c"), F.count_if("parse_failure").alias("overall_f")]
    for t in TYPES:
        active = F.col("flags")[t]
        sums += [F.count_if(active).alias(f"{t}_n"), F.count_if(active & F.col("is_correct")).alias(f"{t}_c"), F.count_if(active & F.col("parse_failure")).alias(f"{t}_f")]
    wide = rows.agg(*sums)
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_n").alias("total"), F.col(f"{n}_c").alias("correct"), F.col(f"{n}_f").alias("parse_failures")) for n in ("overall", *TYPES)]))
    return wide.select(long.alias("r")).select("r.*").withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))


def best_choice(scores: Column) -> Column:
    """The letter with the highest score of a map; the first of equals."""
    entries = F.transform(F.map_entries(scores), lambda e, i: F.struct(e["value"].alias("s"), (-i).alias("r"), e["key"].alias("k")))
    return F.array_max(entries)["k"]


def histogram(df: DataFrame, value: Column, missing: str = "unknown", name: str = "name") -> DataFrame:
    return df.groupBy(F.coalesce(value, F.lit(missing)).alias(name)).agg(F.count("*").alias("n"))
