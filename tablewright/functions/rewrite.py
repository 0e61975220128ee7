"""Rule-made variants of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, let, query_key, strip

# Prefixes with what replaces them, and end-of-query constraints that become "without ...".
LEAD_INS = (
    ("i want to make ", "Looking for "),
    ("i want to prepare ", "Looking for "),
    ("i want to cook ", "Looking for "),
    ("can i have ", "Looking for "),
    ("could i have ", "Looking for "),
    ("show me ", "Looking for "),
    ("give me ", "Need "),
    ("any ideas for ", "Looking for "),
    ("how do i make ", "Looking for "),
    ("how to make ", "Looking for "),
)
PLAIN_LEAD_INS = ("i want ", "i need ")
CONSTRAINTS = (
    r"\bbut not\s+(.+)$",
    r"\bbut I don't like\s+(.+)$",
    r"\bbut I do not like\s+(.+)$",
    r"\bthat don't contain\s+(.+)$",
    r"\bthat do not contain\s+(.+)$",
    r"\bthat doesn't contain\s+(.+)$",
    r"\bthat does not contain\s+(.+)$",
)


def _ends(query: Column) -> Column:
    """struct(body, mark, folded): the query without one terminal punctuation mark, the mark or nothing, the body folded."""

    def cut(text: Column) -> Column:
        mark = F.regexp_extract(text, r"[?.!]\z", 0)
        body = strip(F.when(mark == "", text).otherwise(F.substring(text, F.lit(1), F.length(text) - 1)))
        return let(body, lambda b: F.struct(b.alias("body"), mark.alias("mark"), casefold(b).alias("folded")))

    return let(strip(query), cut)


def _lead_in(ends: Column) -> Column:
    body, mark, folded = ends["body"], ends["mark"], ends["folded"]

    def rule(prefix: str, said: str, fits: Column) -> Column:
        rest = strip(F.substring(body, F.lit(len(prefix) + 1), F.length(body)))

        def told(r: Column) -> Column:
            infinitive = casefold(r).startswith("to ") if said == "Looking for " and prefix not in PLAIN_LEAD_INS else F.lit(False)
            return F.when((r != "") & ~infinitive, F.concat(F.lit(said), r, mark))

        return F.when(fits, let(rest, told))

    rules = [rule(p, said, folded.startswith(p)) for p, said in LEAD_INS]
    return F.coalesce(*rules, *[rule(p, "Looking for ", folded.startswith(p) & ~folded.startswith(p + "to ")) for p in PLAIN_LEAD_INS])


def _constraint(ends: Column) -> Column:
    state = F.struct(ends["body"].alias("text"), F.lit(False).alias("met"))
    patterns = F.array(*[F.lit("(?iUd)" + p) for p in CONSTRAINTS])
    out = F.aggregate(patterns, state, lambda s, p: F.struct(F.regexp_replace(s["text"], p, F.lit(r"without $1")).alias("text"), (s["met"] | F.regexp_like(s["text"], p)).alias("met")))
    return let(out, lambda s: F.when(s["met"], F.concat(s["text"], ends["mark"])))


def lead_in(query: Column) -> Column:
    """The query with another beginning, or null."""
    return let(_ends(query), _lead_in)


def constraint(query: Column) -> Column:
    """All constraints in turn; null if none is met (a rewrite that changes nothing still counts)."""
    return let(_ends(query), _constraint)


def variants(query: Column, most: int = 2) -> Column:
    """array<struct<query, strategy>>: up to ``most`` new variants, in the order lead-in, constraint, both."""
    if most not in (1, 2):
        raise ValueError("most must be 1 or 2")

    def found(first: Column, second: Column) -> Column:
        third = F.when(first.isNotNull(), constraint(first))
        made = F.array(F.struct(first.alias("query"), F.lit("lead_in_rewrite").alias("strategy")), F.struct(second.alias("query"), F.lit("constraint_rewrite").alias("strategy")), F.struct(third.alias("query"), F.lit("lead_in_plus_constraint_rewrite").alias("strategy")))
        return F.transform(F.filter(made, lambda v: v["query"].isNotNull()), lambda v: F.struct(query_key(v["query"]).alias("key"), v["query"].alias("query"), v["strategy"].alias("strategy")))

    def fresh(every: Column) -> Column:
        # the first of equal keys, and none that has the query's own key
        new = F.filter(every, lambda v, i: ~F.exists(F.slice(every, F.lit(1), i), lambda x: x["key"] == v["key"]))
        return F.filter(new, lambda v: v["key"] != query_key(query))

    every = let(_ends(query), lambda e: let(_lead_in(e), lambda first: let(_constraint(e), lambda second: found(first, second))))
    return F.transform(F.slice(let(every, fresh), 1, most), lambda v: F.struct(v["query"].alias("query"), v["strategy"].alias("strategy")))
