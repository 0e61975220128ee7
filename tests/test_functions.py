import random
import re
import unicodedata

from pyspark.sql import functions as F

from tablewright.functions import prompts
from tablewright.functions.parse import parse_choice
from tablewright.functions.rewrite import variants
from tablewright.functions.text import casefold, collapse, query_key, strip, text_key, tokens

OPTIONS = {"A": "Grilled salmon", "B": "Tomato basil soup", "C": "Chocolate lava cake", "D": "Rice pudding", "E": "Chicken noodle casserole"}
ANSWERS = [
    ("A", "A"), ("b", "B"), ("Answer: C", "C"), ("I choose option d.", "D"), ("(E)", "E"), ("A) because it matches oysters", "A"), ("No valid answer", None), ("", None), (None, None),
    ("Option B", "B"), ("The answer is A. Final answer: B", "B"), ("I thought carefully.\nB", "B"), ("\\boxed{D}", "D"), ("A) x B) y C) z D) u E) v", None), ("Best option is tomato basil soup.", "B"),
]


def test_parser(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, a string")
    options = F.create_map(*[F.lit(x) for kv in OPTIONS.items() for x in kv])
    got = {r.i: r.g for r in rows.select("i", parse_choice(F.col("a"), options).alias("g")).collect()}
    assert [got[i] for i in range(len(ANSWERS))] == [w for _, w in ANSWERS]


def test_keys(spark):
    text = spark.createDataFrame([("  Groß \tStraße ?!",), ("Hi ,;:",), ("\x1fa\x1f",)], "t string")
    assert [tuple(r) for r in text.select(text_key(F.col("t")), query_key(F.col("t"))).collect()] == [("gross strasse ", "gross strasse "), ("hi ", "hi ,;:"), ("a", "a")]
    assert spark.range(1).select(tokens(F.lit("héllo you héllo"))).first()[0] == ["héllo", "you"]


def test_text_functions_equal_the_standard_library_on_every_character(spark):
    """But for characters that the two runtimes' Unicode versions tell apart (added after version 13)."""
    rows = [(c, chr(c)) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.ucd_3_2_0.category(chr(c)) != "Cn"]
    t = F.col("t")
    df = spark.createDataFrame(rows, "c int, t string").select("c", casefold(t).alias("fold"), strip(F.concat(t, F.lit(" a "), t)).alias("bare"), tokens(F.concat(F.lit("x"), t, F.lit("y"))).alias("words"), collapse(F.concat(F.lit("x"), t, t, F.lit("y"))).alias("one"))
    got = {r.c: r for r in df.collect()}
    for c, x in rows:
        assert got[c].fold == x.casefold() and got[c].bare == f"{x} a {x}".strip() and got[c].one == re.sub(r"\s+", " ", f"x{x}{x}y"), hex(c)
        assert got[c].words == list(dict.fromkeys(re.findall(r"\w+", f"x{x}y"))), hex(c)


def test_keys_of_long_and_odd_texts(spark):
    texts = ["½ cup x²", "cafe\u0301 au lait", "ﬁne ŉ ſ ẞ ΑΣ Σ", " " * 1_000_000 + "a" + " " * 1_000_000 + "b" + " " * 1_000_000, "?!" * 500_000, "\u3000x\u2028 y\x85."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    key = lambda t: " ".join(t.split()).casefold().rstrip("?.!,;:")
    got = {r.i: (r.k, r.w) for r in df.select("i", text_key(F.col("t")).alias("k"), tokens(text_key(F.col("t"))).alias("w")).collect()}
    assert got == {i: (key(t), list(dict.fromkeys(re.findall(r"\w+", key(t))))) for i, t in enumerate(texts)}


def test_shuffle_is_that_of_the_standard_library(spark):
    import hashlib

    options = [{"option_id": f"o{i}", "text": f"t{i}"} for i in range(5)]
    rows = spark.createDataFrame([(f"k{i}", options) for i in range(20)], "k string, o array<struct<option_id:string,text:string>>")
    for k, got in rows.select("k", prompts.shuffled(F.col("o"), F.col("k"))).collect():
        want = [o["option_id"] for o in options]
        random.Random(int(hashlib.sha256(f"1508:{k}".encode()).hexdigest()[:16], 16)).shuffle(want)
        assert [o.option_id for o in got] == want


def test_variants(spark):
    rows = spark.createDataFrame([("I want to make soup but not fish.",), ("Just soup",), ("I want to eat",), ("Give me something that doesn't contain egg?",)], "q string")
    got = [[(v.query, v.strategy) for v in r[0]] for r in rows.select(variants(F.col("q"))).collect()]
    assert got[0] == [("Looking for soup but not fish.", "lead_in_rewrite"), ("I want to make soup without fish.", "constraint_rewrite")]
    assert got[1] == got[2] == []
    assert got[3][0] == ("Need something that doesn't contain egg?", "lead_in_rewrite") and got[3][1][0] == "Give me something without egg?"
