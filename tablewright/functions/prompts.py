"""Prompts of multiple-choice items, and the order of their options."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

LETTERS = ("A", "B", "C", "D", "E")
SHUFFLE_SEED = 1508
# Fixed value: the text of the prompt.
VERSION = "mc-v1"
TEMPLATE = """Given the following recipe preference query, select the best matching recipe.

Query: %s

Options:
A) %s
B) %s
C) %s
D) %s
E) %s

Respond with only the letter (A-E) of the best option."""


def seed_of(key: Column, seed: int = SHUFFLE_SEED) -> Column:
    """The first 16 hex digits of sha256("seed:key"), as an unsigned decimal string."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16), 16, 10)


@F.pandas_udf(ArrayType(IntegerType()))
def _permutation(seeds: pd.Series, sizes: pd.Series) -> pd.Series:
    def order(seed: str, n: int) -> list[int]:
        places = list(range(n))
        random.Random(int(seed)).shuffle(places)
        return places

    return pd.Series([order(s, int(n)) for s, n in zip(seeds, sizes)])


def shuffled(options: Column, key: Column, seed: int = SHUFFLE_SEED) -> Column:
    """Options in the order of a Mersenne-Twister shuffle; only the permutation is made in Python."""
    return F.transform(_permutation(seed_of(key, seed), F.size(options)), lambda i: F.get(options, i))


def hash_ordered(options: Column, key: Column, seed: int = SHUFFLE_SEED) -> Column:
    """Options (structs with option_id) in the order of sha256("seed:key:option_id"); no Python."""
    keyed = F.transform(options, lambda o: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), key, o["option_id"]), 256).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def checked(options: Column) -> Column:
    return F.when(F.size(options) == 5, options).otherwise(F.raise_error(F.concat(F.lit("Expected exactly 5 options, got "), F.size(options).cast("string"))))


def render(query: Column, options: Column) -> Column:
    return F.format_string(TEMPLATE, query, *[F.get(options, F.lit(i))["text"] for i in range(5)])


def letter_map(options: Column, field: str = "option_id") -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, LETTERS)), F.transform(options, lambda o: o[field]))


def letter_of(options: Column, option_id: Column) -> Column:
    """The letter of an option id, ? if it is not among them."""
    at = F.array_position(F.transform(options, lambda o: o["option_id"]), option_id)
    return F.when(at > 0, F.substring(F.lit("".join(LETTERS)), at.cast("int"), F.lit(1))).otherwise("?")
