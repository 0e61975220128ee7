"""Text keys as Column expressions, with Unicode white space, words and folding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it, and the separators U+001C..U+001F: inside a pattern, and as a list of characters.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: What full case folding makes of characters that lower case leaves as they are, but for the two that are common.
_COMMON = ("ß", "ς")
_FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if c.lower() == c != c.casefold() and c not in _COMMON}


def _ranges(codes: list[int]) -> str:
    """A character class of sorted code points, neighbours as ranges."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and c - runs[-1][1] <= 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in runs) + "]"


_FOLDS = _ranges(sorted(map(ord, _FOLDED)))
#: All of them but one are above Latin letters: one comparison a character spares most texts the other.
_FAR = f"[\\x{{B5}}\\x{{{min(ord(c) for c in _FOLDED if c > 'ÿ'):X}}}-\\x{{1FFFF}}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once though body may name it often."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def casefold(text: Column) -> Column:
    """Full case folding: lower case, and then character by character where a text has one that folds further."""
    table = F.create_map(*[F.lit(x) for pair in _FOLDED.items() for x in pair])

    def fold(low: Column) -> Column:
        each = F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
        return F.when(low.rlike(_FAR) & low.rlike(_FOLDS), F.array_join(each, "")).otherwise(low)

    low = F.lower(text)
    for c in _COMMON:
        low = F.replace(low, F.lit(c), F.lit(c.casefold()))
    return let(low, fold)


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "))


def text_key(text: Column) -> Column:
    """White space collapsed, folded, trailing punctuation gone (a space before it stays)."""
    return F.rtrim(casefold(collapse(text)), F.lit("?.!,;:"))


def query_key(text: Column) -> Column:
    """As text_key, but only sentence ends go."""
    return F.rtrim(casefold(collapse(text)), F.lit("?.!"))


def tokens(key: Column) -> Column:
    """Distinct words of a key: runs of letters, numbers of any kind and _ (combining marks end a word)."""
    return F.array_distinct(F.regexp_extract_all(key, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def jaccard(left: Column, right: Column) -> Column:
    """Of two token arrays; both empty is 1, one empty 0."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)
