"""Quality rules: counts within a document, and lines that many documents of a host share.

Only built-in expressions; nothing here runs Python on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prepare, spare_name, store, with_uid

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, though body names it often."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _covered(hashes: Column) -> Column:
    """How many word places lie in 3-word windows whose hash is found twice or more: sort, compare neighbours."""
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x))
        places = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(places))

    return _let(placed, count)


def line_key(line: Column) -> Column:
    """128-bit digest of a line without case and with white space runs as one space."""
    return F.unhex(F.md5(F.lower(F.array_join(_words(line), " "))))


def document_counts(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = docs.select("uid", "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    words = text.select("uid", "doc_id", _words(F.col("t")).alias("w"), F.regexp_count(F.col("t"), F.lit(SYMBOL)).alias("n_symbols"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    at = lambda i: F.get(F.col("w"), i)
    windows = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    counted = words.select(
        "uid", "doc_id", F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("h"))
    repeat = F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0)).otherwise(_covered(F.col("h"))).cast("long")
    out = counted.select("uid", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def frequent_lines(docs: DataFrame, host: str, least: int, share: float) -> DataFrame:
    """uid, key, words: the lines of each document above its host's limit.

    A line is above it when more than ``least`` documents of the host, and more than ``share`` of
    them, hold it; with a share of 0 the count alone decides, whatever the host's size. Copies of one text count as one document, so a text isn't boilerplate because it
    was copied. All counts are partial sums before they are shuffled; a hot line or host costs one
    row a task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("uid", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("content"), F.explode(F.split(text, "\n", -1)).alias("line"))
    rows = rows.select("uid", "host", "content", line_key(F.col("line")).alias("key"), F.size(_words(F.col("line"))).alias("words")).where("words > 0")
    rows = store(rows.groupBy("uid", "host", "content", "key").agg(F.sum("words").alias("words")), "lines")
    texts = rows.groupBy("host").agg(F.count_distinct("content").alias("texts"))
    held = rows.groupBy("host", "key").agg(F.count_distinct("content").alias("held")).where(F.col("held") > least)
    over = held.join(texts, "host").where(F.col("held") > share * F.col("texts")).select("host", "key")
    return rows.join(over, ["host", "key"]).select("uid", "key", "words")


def quality_rules(docs: DataFrame, host: str = "source", least: int = 10, share: float = 0.2, keep: int = 50) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and the host column; others are ignored).

    Base counts as in ``document_counts``: words are [^\\x20\\x09-\\x0D]+ of the whole text, null is
    no text. base_failed: under 50 words, or over half of the words in repeated 3-word windows. Lines
    that over ``share`` of the host's distinct texts (and over ``least`` of them) hold are removed; a
    document is depleted, and rejected, when under ``keep`` percent of its words are left. A null
    host is a host of its own (as an empty name). Repeated rows are judged alike, each with its own
    row. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = with_uid(docs.select("doc_id", "text", F.col(host).alias("host")))
    host = "host"
    return _judged(docs, frequent_lines(docs, host, least, share), keep)


def _judged(docs: DataFrame, lines: DataFrame, keep: int) -> DataFrame:
    """The counts and verdicts of numbered documents, by their lines above the limits."""
    gone = lines.groupBy("uid").agg(F.sum("words").alias("gone"))
    # stored, as a filter on the result would otherwise be pushed below, and work the arrays out again for each word
    out = store(document_counts(docs), "counts").join(gone, "uid", "left").withColumn("n_line_words_removed", F.coalesce("gone", F.lit(0)).cast("long"))
    left = 100 * (F.col("n_words") - F.col("n_line_words_removed")) >= keep * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & left).drop("gone")


def clean_documents(docs: DataFrame, host: str = "source", least: int = 10, share: float = 0.2, keep: int = 50) -> DataFrame:
    """The documents that stay, with all their columns and without the lines above the limits (n_chars follows the text).

    Parameters and verdicts are those of ``quality_rules``; null texts are rejected, repeated rows are judged
    each, an empty table gives an empty result. Lines are found once, for the verdicts and for the cuts.
    """
    prepare(docs.sparkSession)
    row, bad = spare_name(docs, "_row"), spare_name(docs, "_bad")
    numbered = with_uid(docs.select("doc_id", "text", F.col(host).alias("host")))
    found = store(frequent_lines(numbered, "host", least, share), "frequent")
    verdict = _judged(numbered, found, keep).where("kept").select(F.col("uid").alias(row))
    lines = found.groupBy("uid").agg(F.collect_set("key").alias(bad)).withColumnRenamed("uid", row)
    out = docs.withColumn(row, F.monotonically_increasing_id()).join(verdict.join(lines, row, "left"), row)
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.col(bad), line_key(x))), "\n")
    out = out.withColumn("text", F.when(F.col(bad).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(bad).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
