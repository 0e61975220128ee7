"""Free-text answers to letters: the first of six stages that finds one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, strip

# Patterns and threshold that decide which answers count.
EXACT = r"\(?([A-E])\)?[\)\.\:\-]?"
OPTION = r"OPTION\s*([A-E])[\)\.\:\-]?"
DECLARED = (
    r"\\BOXED\{([A-E])\}",
    r"\b(?:FINAL\s+ANSWER|ANSWER|CORRECT\s+ANSWER|BEST\s+OPTION|BEST\s+MATCHING\s+RECIPE|PREDICTION|CHOICE)\s*(?:IS|:)?\s*\(?([A-E])\)?[\)\.\:\-]?(?=\s|$)",
    r"\b(?:I\s+CHOOSE|I\s+PICK|I\s+SELECT|CHOOSE|PICK|SELECT)\s+(?:OPTION\s*)?\(?([A-E])\)?(?=\b)",
    r"\b(?:MY\s+ANSWER|MY\s+CHOICE)\s*(?:IS|:)\s*\(?([A-E])\)?[\)\.\:\-]?(?=\s|$)",
)
# The same pattern with its letter in one group, as extraction takes one group out.
MENTION = r"OPTION\s+[A-E]\b|(?:^|\s)[A-E]\)"
LEAD = r"\s*\(?([A-E])\)?[\)\.\:\-]\s+\S"
DESCRIBED = r"BEST OPTION IS\s+(.+?)(?:\.|##|\z)"
LEAST_OVERLAP = 0.5


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def _declared(text: Column) -> Column:
    """The declaration that ends last; the earlier pattern wins ties."""
    ends = []
    for i, pattern in enumerate(DECLARED):
        letters = F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(1))
        after = F.length(F.element_at(F.split(text, "(?U)" + pattern, -1), -1))
        ends.append(F.when(F.size(letters) > 0, F.struct((F.length(text) - after).alias("end"), F.lit(-i).alias("rank"), F.try_element_at(letters, F.lit(-1)).alias("letter"))))
    return F.greatest(*ends)["letter"]


def _last(text: Column) -> Column:
    """A letter at the end, unless OPTION or CHOICE stands before it."""
    pattern = r"(?Us)^(.*?(?:^|[\s>])\(?)([A-E])\)?[\)\.\:\-]?\s*\z"
    return F.when(~F.regexp_extract(text, pattern, 1).rlike(r"(?U)(?:OPTION|CHOICE)\s*\z"), _found(text, pattern, 2))


def _leading(text: Column) -> Column:
    """A letter at the start, where under three different letters are mentioned."""
    mentioned = F.transform(F.regexp_extract_all(text, F.lit(f"(?U)({MENTION})"), F.lit(1)), lambda m: F.regexp_extract(m, r"([A-E])\)?\z", 1))
    return F.when(F.size(F.array_distinct(mentioned)) < 3, _found(text, "(?U)^" + LEAD))


def _described(text: Column, options: Column) -> Column:
    """The option whose longer words best cover the last description; the first of equals."""
    described = strip(F.try_element_at(F.regexp_extract_all(text, F.lit("(?dU)" + DESCRIBED), F.lit(1)), F.lit(-1)))

    def best(candidate: Column) -> Column:
        def score(entry: Column, i: Column) -> Column:
            words = F.filter(F.split(strip(F.upper(entry["value"])), f"{SPACE}+"), lambda w: F.length(w) > 3)
            share = lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.contains(candidate, x))) / F.size(w))
            return F.struct(let(words, share).alias("share"), (-i).alias("rank"), entry["key"].alias("letter"))

        return F.array_max(F.transform(F.map_entries(options), score))

    top = let(described, best)
    return F.when(described.isNotNull() & (top["share"] >= LEAST_OVERLAP), top["letter"])


def parse_choice(response: Column, options: Column | None = None) -> Column:
    """The letter A-E that a response chooses, or null; ``options`` (map letter to text) allows the last, fuzzy stage."""

    def stages(text: Column) -> Column:
        found = [_found(text, rf"^{EXACT}\z"), _found(text, rf"(?U)^{OPTION}\z"), _declared(text), _last(text), _leading(text)]
        if options is not None:
            found.append(_described(text, options))
        return F.coalesce(*found)

    return let(F.upper(strip(response)), stages)
