"""Evaluation of a model over items: prompt, ask, parse, score; summaries and comparisons of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.parse import parse_choice
from .items import TYPES
from .metrics import accuracy, best_choice, result_rows
from .providers import ONCE, Calls, Client, with_replies
from .registry import display_name

MODES = ("generative", "loglikelihood")


def evaluate(items: DataFrame, client: Client, mode: str = "generative", limit: int | None = None, order: Callable[[Column, Column], Column] = prompts.shuffled, calls: Calls = ONCE) -> DataFrame:
    """Scored rows (metrics.result_rows, with pos, error, query and the answer's id) of items (pos, example_id, query, options, answer_option_id, flags).

    generative: the client returns a text, parsed without options first, then with them. loglikelihood: it
    returns a score for each letter, the greatest wins. A failed call is an empty reply, so a wrong answer
    and a parse failure, never a lost job. ``limit`` takes the first items by pos. Without a ledger in ``calls`` write
    the rows before aggregating them: reading the frame twice would ask twice.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    rows = items if limit is None else items.orderBy("pos").limit(limit)
    rows = rows.withColumn("options", order(prompts.checked(F.col("options")), F.col("example_id")))
    rows = with_replies(rows, prompts.render(F.col("query"), F.col("options")), client, calls)
    rows = rows.withColumn("letters", prompts.letter_map(F.col("options"))).withColumn("option_texts", prompts.letter_map(F.col("options"), "text"))
    if mode == "generative":
        said = F.coalesce("reply", F.lit(""))
        letter = F.coalesce(parse_choice(said), parse_choice(said, F.col("option_texts")))
    else:
        letter = best_choice(F.from_json("reply", "map<string,double>"))
        said = F.concat(F.lit("[loglikelihood] selected "), F.coalesce(letter, F.lit("None")))
    rows = rows.withColumn("letter", letter).withColumn("raw_response", said)
    return result_rows(rows.withColumn("correct_answer_id", F.col("answer_option_id")), "pos", "error", "query", "correct_answer_id")


def summary(rows: DataFrame, model: str, split: str, mode: str = "generative") -> DataFrame:
    """One row: model, split, eval_mode, metrics as a struct with the overall figures and one struct a type."""
    long = accuracy(rows)

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(column)))

    overall = [of("overall", c).alias(n) for c, n in (("accuracy", "overall"), ("correct", "total_correct"), ("total", "total"), ("parse_failures", "parse_failures"))]
    types = [F.struct(*[of(t, c).alias(c) for c in ("accuracy", "correct", "total")]).alias(t) for t in TYPES]
    return long.agg(F.struct(*overall, *types).alias("metrics")).select(F.lit(model).alias("model"), F.lit(split).alias("split"), F.lit(mode).alias("eval_mode"), "metrics")


def listed(rows: DataFrame) -> DataFrame:
    """The scored rows as they stand in a result document; the options only of wrong ones."""
    # fixed values: the fields of a result
    fields = ("example_id", "query", "correct_answer_id", "correct_letter", "predicted_letter", "predicted_id", "is_correct", "parse_failure", "raw_response", "options")
    return rows.select(F.col("pos").alias("index"), *fields)


def report(result: dict) -> str:
    """A summary row (as a nested dict) as a few lines of text; types without figures are left out."""
    m = result["metrics"]
    lines = [
        f"Model:           {result['model']}", f"Split:           {result['split']} (mode={result.get('eval_mode') or MODES[0]})",
        f"Overall:         {m['overall']:.1%} ({m['total_correct']}/{m['total']})", f"Parse failures:  {m.get('parse_failures') or 0}", "Per query type:"]
    return "\n".join(lines + [f"  {t:<12} {m[t]['accuracy']:.1%} ({m[t]['correct']}/{m[t]['total']})" for t in TYPES if m.get(t)])


def leaderboard(results: DataFrame, bases: DataFrame | None = None, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(name, split, total, correct, percent, parse_failures) of result summaries (model, split, metrics variant).

    ``bases``: model and base of adapters, which are named after their base. ``only`` and ``exclude`` hold names.
    """
    named = results.withColumn("base", F.lit(None).cast("string")) if bases is None else results.join(bases.select("model", "base"), "model", "left")
    figure = lambda path, kind: F.try_variant_get("metrics", f"$.{path}", kind)
    out = named.select(display_name(F.col("base"), F.col("model")).alias("name"), "split", figure("total", "bigint").alias("total"), figure("total_correct", "bigint").alias("correct"),
                       F.coalesce(figure("parse_failures", "bigint"), F.lit(0)).alias("parse_failures"))
    if only is not None:
        out = out.where(F.col("name").isin(only))
    if exclude:
        out = out.where(~F.col("name").isin(exclude))
    return out.withColumn("percent", F.coalesce(F.try_divide(F.col("correct") * 100, F.col("total")), F.lit(0.0)))


def bar_chart(bars: list[tuple[str, float]], title: str, width: int = 640) -> str:
    """An SVG of horizontal bars on a scale from 0 to 100; for reports of few rows."""
    safe = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    left, step = 230, 26
    room, height = width - left - 70, 50 + step * len(bars)
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">', f'<text x="10" y="22" font-size="15">{safe(title)}</text>']
    for i, (name, percent) in enumerate(bars):
        y = 40 + step * i
        parts += [f'<text x="{left - 8}" y="{y + 14}" text-anchor="end">{safe(name)}</text>', f'<rect x="{left}" y="{y}" width="{room * percent / 100:.1f}" height="18" fill="#3b6ea5"/>', f'<text x="{left + room * percent / 100 + 6:.1f}" y="{y + 14}">{percent:.1f}</text>']
    return "\n".join([*parts, "</svg>"])
