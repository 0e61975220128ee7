import hashlib
import json
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.conftest import DATA, as_rows

import corpus_pipeline
from tablewright.llm import chat_format, exact_dedup, jaccard_join, line_dedup, packing, piece_coding, quality_rules, queries, shared, substring_dedup, toxicity, url_filter
from tablewright.llm.components import components
from tablewright.llm.hashing import Words, window_hash, window_minima

SPACE = " \t\n\x0b\x0c\r"
# nulls, empty and blank texts, repeated rows, ties, a long text, columns with names the operators use themselves
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (4, "a b"), (5, "A  b"), (None, "a b"), (6, "x y z " * 9000), (7, "line one here\nline two here\nline three here\nend"), (8, "line one here\nline two here\nline three here\nend"), (9, "ﬁ　x\x1cé ▁ </s>")]
WIDE = "doc_id long, text string, uid long, entry long, _row long, source string, n long, host string, kept boolean"


def wide(rows):
    return [(d, t, 0, 0, 0, "s" if i % 2 else None, 7, "h", True) for i, (d, t) in enumerate(rows)]


def words(text, lower=False):
    out, text = [], text or ""
    for c in SPACE:
        text = text.replace(c, " ")
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in text.split(" ") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name])
    assert as_rows([tuple(r) for r in got.collect()], got.columns) == as_rows(want.fetchall(), list(want.columns))


MODEL = lambda: __import__("public_tokenizers").path("piece_bpe_32k.model")
OPERATORS = {
    "lines": line_dedup.line_dedup, "exact": exact_dedup.exact_dedup, "substring": substring_dedup.substring_dedup, "jaccard": jaccard_join.jaccard_components, "quality": quality_rules.quality_rules,
    "pieces": lambda d: piece_coding.piece_coding(d, MODEL()), "packing": lambda d: packing.pack(d, queries.byte_tokenizer()),
    "toxicity": lambda d: toxicity.toxicity(d, d.select("doc_id", F.lit(1).alias("toxic")).where("doc_id < 3"), {"toxic": "toxic"}),
    "clean": quality_rules.clean_documents, "first": exact_dedup.keep_first_copies, "near": jaccard_join.keep_one_of_each, "repeats": substring_dedup.drop_repeats,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_and_odd_tables(spark, table, name):
    assert OPERATORS[name](table([], WIDE)).collect() == []
    got = OPERATORS[name](table(wide(ODD), WIDE)).collect()
    ids = Counter(r.doc_id for r in got)
    if name in ("clean", "first", "near", "repeats"):
        assert got == [] or got[0].__fields__ == WIDE.replace(",", "").split()[::2]
        assert {"first": 6}.get(name) in (None, len(got))
    elif name == "packing":
        assert set(ids) == {d for d, _ in ODD}
    else:
        assert ids == Counter(d for d, _ in ODD)


def test_every_line_reaches_documents_of_one_and_two_lines(spark, tmp_path):
    rows = [(1, "one line"), (2, "one  line"), (3, "two\nlines"), (4, "two\n\nlines"), (5, "new\none line\nend"), (6, "alone"), (7, None), (8, "a\na")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op1_line_dedup_every_line"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0, sha("one line")), 2: (1, 1, sha("")), 3: (2, 0, sha("two\nlines")), 4: (2, 2, sha("")), 5: (3, 1, sha("new\nend")), 6: (1, 0, sha("alone")), 7: (0, 0, sha("")), 8: (2, 1, sha("a"))}


def test_exact_dedup_collisions_and_ties(table):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("ab \n") for _ in range(r.randrange(4)))) for i in range(300)] + [(5, "ab"), (5, "ab"), (None, "ab")]
    for bits, buffer, hot in ((64, 1 << 20, 64), (2, 10, 64), (64, 10, 2), (1, 10, 3)):
        got = exact_dedup.exact_dedup(table(rows, "doc_id long, text string"), capacity=20, buffer_bytes=buffer, key_bits=bits, hot=hot).collect()
        groups = {}
        for d, t in rows:
            groups.setdefault("".join(t.split()), []).append((-len(t), 1 << 62 if d is None else d))
        best = {k: (min(g)[1], len(g)) for k, g in groups.items()}
        want = sorted((d or -1, *best["".join(t.split())], sha("".join(t.split()))) for d, t in rows)
        assert sorted((x.doc_id or -1, x.keep_id, x.group_size, x.text_sha256) for x in got) == want
        assert sum(x.kept for x in got) == len(best)


def test_directory_splits_until_buckets_fit():
    depth, slots = exact_dedup.directory({0: 5, 1: 5, 7: 9, 6: 1, 4: 1}, 9, 3)
    assert depth == 3 and len(slots) == 8 and slots[0] != slots[1] and slots[6] != slots[7] and slots[2] == slots[3]
    assert exact_dedup.directory({3: 100}, 9, 3) == (0, [0])


def test_owners_hold_ranges_of_whole_buckets():
    r = random.Random(8)
    for _ in range(50):
        held = {p: r.randrange(1, 100) for p in r.sample(range(64), 40)}
        depth, slots = exact_dedup.directory(held, 60, 6)
        got = exact_dedup.owners(held, slots, 6, 5)
        assert got == sorted(got) and set(got) <= set(range(5)) and len({(s, o) for s, o in zip(slots, got)}) == len(set(slots))


def test_very_long_texts(spark, table):
    """Texts of megabytes (blanks, one word, short lines, one passage over and over), values held to plain loops."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, " " * 3_000_000), (2, "x" * 2_000_000), (3, "\n" * 1_000_000 + "a b c"), (4, "a b c"), (5, "é" * 1_000_000 + " y"), (6, f"{passage}\n" * 300 + "end"), (7, f"start {passage}"), (8, "x" * 2_000_000), (9, None)]
    docs = table(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {d: ({1: 1, 9: 1, 8: 2, 3: 3, 4: 3}.get(d, d), 1 + (d in (1, 9, 2, 8, 3, 4)), sha("".join(words(t)))) for d, t in rows}
    got = substring_dedup.substring_dedup(docs).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got) == _substring(rows, 35)
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == _components(rows, 3, 90)
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_dedup(docs, 1).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (1, 0), 4: (1, 1), 5: (1, 0), 6: (301, 299), 7: (1, 0), 8: (1, 1), 9: (0, 0)}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs.withColumn("source", F.lit("s"))).collect()}
    size = {d: len(words(t)) for d, t in rows}
    assert got == {d: (size[d], sum(map(len, words(t))), 299 if d == 6 else 0, 18_000 if d == 6 else 0, d != 7) for d, t in rows}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_coding.piece_coding(docs, MODEL()).collect()}
    for d, t in rows:
        ids = model.encode(t or "")
        assert got[d] == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def test_rows_of_a_block_do_not_grow_with_the_partitions(spark, docs_in_files, monkeypatch):
    """A block sends at most one row an owner, whatever the number of partitions; values are the library's."""
    import pandas as pd
    import sentencepiece

    asked, real = [], piece_coding._words
    monkeypatch.setattr(piece_coding, "_words", lambda block, buckets: asked.append(buckets) or real(block, buckets))
    cut = docs_in_files.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("uid"))
    made = cut.mapInArrow(real(20_000, 8), piece_coding._ROWS).groupBy("block").count().toPandas()
    assert made["count"].max() <= 8 and len(made) > 5
    model, old = sentencepiece.SentencePieceProcessor(model_file=MODEL()), spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("400", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        piece_coding.piece_coding(docs_in_files, MODEL(), owners=8)
    assert asked == [8, 8]
    got = piece_coding.piece_coding(docs_in_files, MODEL(), block=20_000, owners=8)
    got = got.toPandas().set_index("doc_id")
    spark.conf.set("spark.sql.shuffle.partitions", old)
    want = pd.DataFrame([(r.doc_id, sha(",".join(map(str, model.encode(r.text or ""))))) for r in docs_in_files.collect()], columns=["doc_id", "h"]).set_index("doc_id")
    assert got.ids_sha256.sort_index().tolist() == want.h.sort_index().tolist()


@pytest.fixture
def docs_in_files(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stages_leave_no_tables(spark, tmp_path, monkeypatch):
    """Of the tables that the stages store only those of the last are there when run() returns; a block that fails drops its own."""
    from tablewright.llm import shared

    monkeypatch.setattr(shared, "shared_folder", lambda s: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, DATA)
    names = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if any(p.rglob("*.parquet")))
    assert [n for n in names if n.startswith("pipeline-")] == ["pipeline-substring"] and len(names) <= 3
    assert out.count() > 0
    before = set(tmp_path.iterdir())
    with pytest.raises(RuntimeError), shared.passing_tables(spark):
        kept = shared.store(spark.range(3), "kept", stays=True)
        shared.store(spark.range(3), "gone")
        raise RuntimeError("stopped")
    assert kept.count() == 3 and [p.name.split("-")[0] for p in set(tmp_path.iterdir()) - before] == ["kept"]


def _substring(rows, least):
    split = [words(t) for _, t in rows]
    met = Counter(tuple(w[i : i + least]) for w in split for i in range(len(w) - least + 1))
    out = []
    for (d, _), w in zip(rows, split):
        gone = {j for i in range(len(w) - least + 1) if met[tuple(w[i : i + least])] > 1 for j in range(i, i + least)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("least,k,hot", [(12, 4, 256), (12, 4, 2), (35, 8, 3)])
def test_substring_dedup_against_brute_force(table, least, k, hot):
    r = random.Random(least + hot)
    base, rows = [[r.choice("abcdefgh") for _ in range(60)] for _ in range(5)], []
    for i in range(120):
        w = []
        for _ in range(r.randrange(5)):
            at = r.randrange(60)
            w += r.choice([r.choice(base), r.choice(base)[at : at + r.randrange(1, 50)], [r.choice("xy")] * r.randrange(1, 90), [str(r.random()) for _ in range(20)]])
        rows.append((i, r.choice([" ", "\n ", "\t"]).join(w)))
    rows += rows[:4]
    got = substring_dedup.substring_dedup(table(rows, "doc_id long, text string"), least, k, hot).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got) == _substring(rows, least)


def thue_morse(letters="ab"):
    """1,024 letters, and the same with the letters swapped: equal under any polynomial hash modulo 2**64."""
    swap, word = str.maketrans(letters, letters[::-1]), letters[0]
    for _ in range(10):
        word += word.translate(swap)
    return word, word.translate(swap)


def test_words_that_collide_under_polynomial_hashes_are_told_apart(table):
    a, b = thue_morse()
    tail = " ".join(f"t{i}" for i in range(42))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} y z"), (4, f"{b} y z"), (5, " ".join(a)), (6, " ".join(b))]
    assert len(set(Words([a, b]).hash.tolist())) == 2 and len({int(window_hash(Words([" ".join(t)]).hash, 1024)[0]) for t in (a, b)}) == 2
    got = substring_dedup.substring_dedup(table(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got) == _substring(rows, 35)
    assert {x.doc_id: x.n_removed for x in got if x.doc_id < 3} == {1: 42, 2: 42}
    got = jaccard_join.jaccard_components(table(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == _components(rows, 3, 90)


def test_a_document_that_leads_ten_thousand_anchors(table):
    """Its anchors are spread over many shards, and a repeated passage that lies across their borders is found whole."""
    r = random.Random(9)
    long = [f"w{r.randrange(10**9)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[::-1])), (3, " ".join(long[:80_000] + ["new"] + long[80_000:]))]
    rows += [(10 + i, " ".join([f"own{i}", *long[at : at + n], f"end{i}"])) for i, (at, n) in enumerate([(0, 34), (200, 35), (240, 40), (500, 3000), (149_960, 40)] * 2)]
    got = substring_dedup.substring_dedup(table(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got) == _substring(rows, 35)


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=14), min_size=1, max_size=5), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_automaton_finds_repeated_spans(texts, least):
    a = substring_dedup.SuffixAutomaton()
    for t in texts:
        a.add(t)
    a.finish()
    met = Counter(tuple(t[i : i + least]) for t in texts for i in range(len(t) - least + 1))
    for t in texts:
        want = {j for i in range(len(t) - least + 1) if met[tuple(t[i : i + least])] > 1 for j in range(i, i + least)}
        assert {j for lo, hi in a.repeated(t, least) for j in range(lo, hi)} == want


@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_winnowing_guarantee(values, width):
    v = np.array(values, dtype=np.uint64)
    at = set(window_minima(v, np.array([0, len(v)]), width).tolist())
    for i in range(len(v) - width + 1):
        assert any(v[j] == v[i : i + width].min() for j in range(i, i + width) if j in at)


def _components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words(t, True)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,percent,hot,block", [(3, 90, 64, 1024), (5, 80, 2, 3)])
def test_jaccard_join_against_brute_force(table, k, percent, hot, block):
    r, rows = random.Random(3), []
    vocabulary, shared = [f"W{i}" for i in range(300)], [f"s{i}" for i in range(30)]
    for _ in range(45):
        base = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 8, 12, 25, 60, 150, 400]))] + shared * (r.random() < 0.4)
        for _ in range(r.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.randrange(max(2, len(w) // 25))):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    got = jaccard_join.jaccard_components(table(rows, "doc_id long, text string"), k, percent, block=block, hot_least=hot).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == _components(rows, k, percent)


def test_shingles_whose_hashes_collide_are_counted_by_their_words(table):
    one, other = "collisionofwords", "0xunvvfu^}x18\\@$"
    rows = [(1, f"{one} y z q {other} y z"), (2, f"{one} y z q {one} y z"), (3, None), (4, ""), (5, f"{other} y"), (6, f"{one} y"), (7, f"{other} y z")]
    assert len(set(Words([one, other]).hash.tolist())) == 1  # or this test says nothing
    got = jaccard_join.jaccard_components(table(rows, "doc_id long, text string"), block=4).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == _components(rows, 3, 90)
    assert {x.doc_id: x.n_shingles for x in got if x.doc_id < 3} == {1: 5, 2: 4}


def test_jaccard_join_of_sets_of_thousands(table):
    """Large classes, where linked sets must share several keys, on both sides of the threshold."""
    r, rows = random.Random(11), []
    for size in (1200, 3000, 6000):
        base = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for share in (0.005, 0.012, 0.016, 0.0175, 0.019, 0.022):  # three shingles a word: links end near 1.75 %
            for _ in range(3):
                w = list(base)
                for at in r.sample(range(size), int(share * size)):
                    w[at] = f"x{r.randrange(10**9)}"
                rows.append((len(rows), " ".join(w)))
    want = _components(rows, 3, 90)
    assert 3 < len({c for _, _, c in want}) < len(rows)
    got = jaccard_join.jaccard_components(table(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == want


@pytest.mark.parametrize("change", [1, 2, 5])
def test_rows_dealt_grow_with_the_family(spark, table, change):
    """Whole sets sent to blocks of 8, for families of 64, 128, 256 (and 512) near copies of one text.

    Of copies with one word changed all are linked, with five changed none are. With two changed those with
    changes at adjoining places are: such families are held against each other in slices, and grow faster.
    """
    sent = []
    for n in (64, 128, 256, 512) if change == 5 else (64, 128, 256):
        r = random.Random(n)
        base, rows = [f"w{i}" for i in range(200)], []
        for i in range(n):
            w = list(base)
            for at in r.sample(range(200), change):
                w[at] = f"x{r.randrange(10**9)}"
            rows.append((i, " ".join(w)))
        tally = spark.sparkContext.accumulator(0)
        got = jaccard_join.jaccard_components(table(rows, "doc_id long, text string"), block=8, tally=tally).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == _components(rows, 3, 90)
        sent.append(tally.value)
    if change == 1:  # all are linked: each set once, the leader once a block
        assert sent == [64 + 7, 128 + 15, 256 + 31]
    if change == 5:
        assert all(more <= 2.5 * less for less, more in zip(sent, sent[1:])), sent  # a few sets still meet in slices


def test_a_family_of_several_bases_is_parted(spark, table):
    """Near copies of texts that are near each other, but not linked: those of other bases are far from the leader, and have leaders of their own."""
    r, rows = random.Random(9), []
    root = [f"w{i}" for i in range(200)]
    for b in range(6):
        base = list(root)
        for at in r.sample(range(200), 5):
            base[at] = f"b{b}x{at}"
        for _ in range(24):
            w = list(base)
            w[r.randrange(200)] = f"x{r.randrange(10**9)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    tally = spark.sparkContext.accumulator(0)
    got = jaccard_join.jaccard_components(table(rows, "doc_id long, text string"), block=8, tally=tally).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == _components(rows, 3, 90)
    assert tally.value <= 12 * len(rows)


def test_families_with_several_groups_are_joined_exactly(table):
    """Chains of copies: each is near the next one only, so blocks leave sets open and rounds go on."""
    r, rows = random.Random(4), []
    for c in range(3):
        w = [f"c{c}w{i}" for i in range(200)]
        for _ in range(40):
            rows.append((len(rows) * 11 % 127, " ".join(w)))
            for at in r.sample(range(200), 3):
                w[at] = f"x{r.randrange(10**9)}"
    got = jaccard_join.jaccard_components(table(rows, "doc_id long, text string"), block=4).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == _components(rows, 3, 90)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=6), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_gram_table_numbers_grams_by_their_words(texts, k):
    owner, column = jaccard_join.gram_table([" ".join(t).encode() for t in texts], k)
    want = [{tuple(t[i : i + k]) for i in range(len(t) - k + 1)} if len(t) >= k else {tuple(t)} - {()} for t in texts]
    got = [set(column[owner == i].tolist()) for i in range(len(texts))]
    assert [len(g) for g in got] == [len(w) for w in want] and len(column) == sum(map(len, got))
    assert all(len(got[i] & got[j]) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(i))


def test_keys_met_by_slices(spark, tmp_path):
    """Keys shuffled in ranges, one after the other, give what one shuffle of all gives."""
    r = random.Random(9)
    rows = list({(r.choice([-1, 1]) * (r.randrange(60) << 57) + r.randrange(2), r.randrange(40)) for _ in range(400)})
    rows = [(jaccard_join._KEY if i % 5 else jaccard_join._STAR, max(-(1 << 63), min((1 << 63) - 1, a)), b, i % 2) for i, (a, b) in enumerate(rows)]
    rows += [(jaccard_join._KEY, a, b, n) for a, b, n in ((-(1 << 63), 1, 0), (-(1 << 63), 2, 1), ((1 << 63) - 1, 1, 0), ((1 << 63) - 1, 3, 0))]
    spark.createDataFrame(rows, "kind byte, a long, b long, n long").write.parquet(str(tmp_path / "keys"))
    by, want = {}, Counter()
    for kind, a, b, n in rows:
        if kind == jaccard_join._KEY:
            by.setdefault(a, []).append((b, n))
    for group in by.values():
        for b, n in group if len(group) > 1 else ():
            want[b, min(x for x, _ in group)] += 1 - n
    for most in (1, 8):
        got = jaccard_join._met_keys(spark.read.parquet(str(tmp_path / "keys")), slice_rows=20, most=most).collect()
        assert sorted((x.b, x.lead, x.more) for x in got) == sorted((*k, n) for k, n in want.items())


def test_components_end_in_one_task_when_few_edges_are_left(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(5, 5), (1000, 1000)]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(3)
    by_bound = [sorted(map(tuple, components(frame, bound=b, **more).collect())) for b, more in ((100, {}), (1 << 18, {"most_rounds": 1}))]
    assert by_bound[0] == by_bound[1] and len({c for _, c in by_bound[0]}) > 5


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    least = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(400):
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == least


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_is_gapless_without_padding(histogram):
    plan, held = packing.Plan(histogram, 64), {}
    for length, n in histogram.items():
        for rank in range(n):
            pieces = list(plan.pieces(length, rank))
            assert sum(p[0] for p in pieces) == length
            for take, window, offset in pieces:
                held.setdefault(window, []).append((offset, take))
    short = 0
    for pieces in held.values():
        end = 0
        for offset, take in sorted(pieces):
            assert offset == end
            end += take
        short += end != 64
        assert end == 64 or end & (end - 1) == 0
    assert short <= 6


def test_best_fill():
    r = random.Random(1)
    for _ in range(200):
        counts, room = {r.randrange(1, 12): r.randrange(1, 3) for _ in range(4)}, r.randrange(1, 30)
        sums = {0}
        for c, n in counts.items():
            sums = {s + c * i for s in sums for i in range(n + 1)}
        fill = packing.best_fill(counts, room)
        assert all(n <= counts[c] for c, n in fill.items()) and sum(c * n for c, n in fill.items()) == max(s for s in sums if s <= room)


def _pieces_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.byte_tokenizer()[0])
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in texts}


def test_packing_holds_every_id_once(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    ids, places, held = _pieces_of(docs), {}, {}
    for r in queries.op4_packing(spark, DATA).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        places.setdefault(r.doc_id, []).append((r.start, r.length))
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, size in [(places[d], len(x)) for d, x in ids.items()] + [(p, None) for p in held.values()]:
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end == size if size is not None else end == 1024 or end & (end - 1) == 0


@pytest.mark.parametrize("gap", [" ", "\n", "\t", " \n"])
def test_packing_of_very_long_white_space_and_words(table, gap):
    """Texts of 1,000,000 and 5,000,000 characters, held to the library's ids."""
    rows = [(1, f"a{gap * 1_000_000}b"), (2, gap * 5_000_000), (3, "x" * 1_000_000), (4, "漢" * 100_000 + gap * 400_000), (5, "word " * 300_000)]
    ids, places = _pieces_of(rows), {}
    for r in packing.pack(table(rows, "doc_id long, text string"), queries.byte_tokenizer()).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        places.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {d: sum(n for _, n in p) for d, p in places.items()} == {d: len(x) for d, x in ids.items()}


def test_special_token_in_a_text_is_that_of_the_library(table):
    rows = [(1, "a <|endoftext|> b"), (2, "plain")]
    assert {r.doc_id: r.doc_tokens for r in packing.pack(table(rows, "doc_id long, text string"), queries.byte_tokenizer()).collect()} == {d: len(x) for d, x in _pieces_of(rows).items()}


def test_piece_coding_equals_the_library(spark, table):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL())
    odd = [" a", " ", "  ", "", "a ", "a  ", "\n", "\n\na", "a \nb", "▁a b", "a\tb  c\n", "\x00 \x1c x　y", " \n", "a\n  b\n ", "é \n\n é", None]
    rows = list(enumerate(odd)) + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for r in piece_coding.piece_coding(table(rows, "doc_id long, text string"), MODEL(), True).collect():
        want = model.encode(dict(rows)[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want) and r.ids_sha256 == sha(",".join(map(str, want))) and r.decoded_sha256 == sha(model.decode(want))


def test_each_chunk_of_the_corpus_reaches_the_library_once(spark, monkeypatch):
    """Two tasks' blocks, their owners and the answers, with the library's calls counted."""
    import pyarrow as pa

    asked, learn = Counter(), piece_coding.ChunkTable.learn

    def counted(self, chunks):
        asked.update(c for c in chunks if c not in self.shown)
        learn(self, chunks)

    monkeypatch.setattr(piece_coding.ChunkTable, "learn", counted)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [None, "", "\n \n", "▁ a", "one"]
    rows = []
    for task in range(2):
        mine = texts[task::2]
        numbers = pa.array(range(len(mine)), pa.int64())
        batch = pa.RecordBatch.from_arrays([numbers, pa.array(mine, pa.string()), pa.array([n.as_py() + (task << 33) for n in numbers], pa.int64())], names=["doc_id", "text", "uid"])
        for out in piece_coding._words(20_000, 5)([batch.slice(0, 7), batch.slice(7)]):
            rows += out.to_pylist()
    assert len({r["block"] for r in rows}) > 4
    rows.sort(key=lambda r: r["part"])
    told = [r for out in piece_coding._owner(MODEL())([pa.RecordBatch.from_pylist(rows[:9], schema=piece_coding._rows([(0, 0, 0, b"")]).schema), pa.RecordBatch.from_pylist(rows[9:], schema=piece_coding._rows([(0, 0, 0, b"")]).schema)]) for r in out.to_pylist()]
    assert [(r["block"], r["part"]) for r in told] == [(r["block"], r["part"]) for r in rows]
    want = {c for t in texts if t for c in (piece_coding._cut(t) or [])[1:]}
    assert set(asked) == want | {"\n"} and set(asked.values()) == {1}


@pytest.mark.parametrize("block", [1, 300, 10_000])
def test_blocks_of_any_size_give_the_same_codes(spark, block):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    show = lambda d: sorted(map(tuple, d.collect()))
    assert show(piece_coding.piece_coding(docs, MODEL(), block=block)) == show(piece_coding.piece_coding(docs, MODEL()))


def test_piece_coding_of_odd_characters(table):
    """Every character of a few planes, alone, inside words and beside blanks, held to the library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL())
    rows = [(i, "".join(f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}\n{chr(c)}" for c in range(i * 64, i * 64 + 64) if not 0xD800 <= c < 0xE000)) for i in range(0, 1100)]
    for r in piece_coding.piece_coding(table(rows, "doc_id long, text string"), MODEL()).collect():
        ids = model.encode(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))), r.doc_id


@given(st.sampled_from(["user", "assistant", "a\\n\nb", "<s>"]), st.text(alphabet="a\\<s>/[INST]\n", max_size=30))
@settings(max_examples=300, deadline=None)
def test_template_reads_back(role, text):
    part, low, high = chat_format.format_turn(role, text)
    assert chat_format.read_turn(part) == (role, text)
    inner = part[3:-4] if role == "assistant" else part[6:-7]
    assert not any(c in inner for c in chat_format.CONTROL)
    assert role != "assistant" or chat_format.unescape(part[low:high]) == text


def test_layouts(spark):
    asked = [("user", "q"), ("assistant", "a")]
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}, asked),
        ({"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a", "tool_calls": [{"id": 1}]}], "topic": "t"}, asked),
        ({"conversations": [{"from": "human", "value": "q", "weight": 1}, {"from": "gpt", "value": "a"}]}, asked),
        ({"instruction": "q", "input": "", "output": "a"}, asked), ({"instruction": "q", "output": "a"}, asked), ({"instruction": "q", "input": "x", "output": "a", "license": "l"}, [("user", "q\nx"), ("assistant", "a")]),
        ({"prompt": "q", "completion": "a", "score": 1}, asked), ({"system": None, "question": "q", "answer": "a"}, asked), ({"question": "q", "answer": "a"}, asked),
        ({"role": "gpt", "text": "a"}, [("gpt", "a")]), ({"messages": [{"role": "user"}, {"content": "a"}]}, [("user", ""), ("", "a")]),
        ({"messages": []}, "no turns"), ({"messages": None}, "no turns"), ({"unknown": 1}, "unknown layout"), ([1], "not an object"), ("{", "not readable"), (None, "not readable"), ({"messages": "text"}, "not readable"),
    ]
    df = spark.createDataFrame([(i, 0, x if x is None or x == "{" else json.dumps(x)) for i, (x, _) in enumerate(records)], "conv_id long, turn long, record string")
    rows = chat_format.canonical_turns(df).collect()
    for i, (_, want) in enumerate(records):
        got = [r for r in sorted(rows, key=lambda r: r.sub) if r.conv_id == i]
        assert [r.reason for r in got] == [want] if isinstance(want, str) else [(r.role, r.text) for r in got] == want
    digests = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.format_records(df).collect()}
    assert digests == {i: (0, 0) if isinstance(w, str) else (len(w), sum(len(t) for r, t in w if r == "assistant")) for i, (_, w) in enumerate(records)}


def test_conversations_keep_roles_and_long_and_odd_turns(spark):
    long = "</s>" * 500_000 + "\\" * 1000
    odd = spark.createDataFrame([(1, None, None, None, 0), (1, 0, "assistant", None, 0), (None, 0, "user", "x", 0), (1, 0, "assistant", None, 0), (2, 0, "gpt", "g", 1), (2, 1, "human", "h", 1), (3, 5, "assistant", long, 1), (3, 2, "model", long, 1)], "conv_id long, turn long, role string, text string, part long")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.format_conversations(odd).collect()}
    assert got == {
        1: (3, sha("\n\nassistant\n\nassistant\n\n"), 0, sha("")), None: (1, sha("user\nx\n"), 0, sha("")), 2: (2, sha("gpt\ng\nhuman\nh\n"), 0, sha("")),
        3: (2, sha(f"model\n{long}\nassistant\n{long}\n"), len(long), sha(long))}
    assert chat_format.format_conversations(odd.where("false")).collect() == []


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    got = toxicity.toxicity(docs, labels.join(held, "doc_id", "left_anti"), {"low_quality": "1 - quality", "toxic": "toxic"})
    rows = got.withColumnRenamed("toxic", "flag").join(held, "doc_id").select("flag", "toxic").collect()
    missed, bad = sum(r.toxic == 1 and not r.flag for r in rows), sum(r.toxic == 1 for r in rows)
    wrong, clean = sum(r.toxic == 0 and r.flag for r in rows), sum(r.toxic == 0 for r in rows)
    # some labels are noise: toxic ones without a toxic word
    assert missed <= 0.15 * bad and wrong <= 0.005 * clean


def _newton(x, y, ridge=1e-3):
    """Weights and bias (unpenalised) at the optimum of the logistic loss, by Newton steps over dense rows."""
    n, k = x.shape
    full, w, penalty = np.column_stack([x, np.ones(n)]), np.zeros(k + 1), np.append(np.full(k, ridge / 8), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-full @ w))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full / n + np.diag(penalty + 1e-12), full.T @ (p - y) / n + penalty * w)
        w -= step
        if abs(step).max() < 1e-10:
            break
    return lambda rows: 1 / (1 + np.exp(-(np.column_stack([rows, np.ones(len(rows))]) @ w)))


def test_toxicity_equals_a_brute_force_chain(spark, table, monkeypatch):
    """Both links, their out-of-fold features, the threshold and the verdicts, on few words, where no feature is left out."""
    from functools import partial

    monkeypatch.setattr(toxicity, "fit_linear", partial(toxicity.fit_linear, steps=4000))
    r, texts, labels = random.Random(11), {}, {}
    for d in range(420):
        bad = r.random() < 0.3
        low = r.random() < (0.8 if bad else 0.2)
        said = [f"w{r.randrange(24)}" for _ in range(12)] + ["vile"] * (bad and r.random() < 0.8) + ["sloppy"] * (low and r.random() < 0.7)
        texts[d], labels[d] = " ".join(r.sample(said, len(said))), (int(not low), int(bad))
    known = [d for d in texts if d % 7]  # the others are only scored
    words_of = {d: set(t.split()) for d, t in texts.items()}
    vocabulary = sorted(set().union(*words_of.values()))
    every = np.array([[w in words_of[d] for w in vocabulary] for d in texts], float)
    x, fold = every[known], np.arange(len(known)) % 3
    held, scores = np.zeros((len(known), 0)), np.zeros((len(texts), 0))
    for link in range(2):
        y = np.array([1 - labels[d][0] if link == 0 else labels[d][1] for d in known], float)
        seen, out = np.column_stack([x, held]), np.zeros(len(known))
        for f in range(3):
            out[fold == f] = _newton(seen[fold != f], y[fold != f])(seen[fold == f])
        scores = np.column_stack([scores, _newton(seen, y)(np.column_stack([every, scores]))])
        held = np.column_stack([held, out])
    quality = {}
    for t in np.linspace(0.1, 0.9, 17):
        flagged = out >= t
        quality[t] = 1.25 * y[flagged].sum() / max(1.0, flagged.sum() + 0.25 * y.sum())
    best = [t for t, q in quality.items() if q >= max(quality.values()) - 1e-9]
    threshold = best[len(best) // 2]

    got = toxicity.toxicity(table(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(d, *labels[d]) for d in known], "doc_id long, quality int, toxic int"), {"low_quality": "1 - quality", "toxic": "toxic"})
    rows = got.collect()
    assert sorted(g.doc_id for g in rows) == sorted(texts) and {g.toxic for g in rows} == {True, False}
    for g in rows:
        assert abs(g.p_low_quality - scores[g.doc_id, 0]) < 0.01 and abs(g.p_toxic - scores[g.doc_id, 1]) < 0.01
        assert g.toxic == (scores[g.doc_id, 1] >= threshold) or abs(scores[g.doc_id, 1] - threshold) < 0.01


def _walk(edges, seeds, damping):
    """Personalised PageRank by power steps over dicts; a host without links returns to the seeds."""
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()}
    out, rank = Counter(), dict(start)
    for (u, _), w in edges.items():
        out[u] += w
    for _ in range(400):
        new = Counter({h: (1 - damping) * s for h, s in start.items()})
        for (u, v), w in edges.items():
            new[v] += damping * rank.get(u, 0) * w / out[u]
        lost = damping * sum(s for h, s in rank.items() if not out[h])
        for h, s in start.items():
            new[h] += lost * s
        rank = new
    return rank


def _seeds(spark, **weights):
    return spark.createDataFrame([(h.replace("_", "."), float(w)) for h, w in weights.items()], "host string, weight double")


def test_url_verdicts_equal_a_brute_force_pagerank(spark, table):
    """Hosts of a random graph with links across; names tell nothing about the verdicts."""
    r = random.Random(6)
    hosts = [f"h{i}.{r.choice(['aa', 'bb'])}.com" for i in range(30)]
    rows, edges = [], Counter()
    for i in range(200):
        src, to = r.choice(hosts[:25]), [r.choice(hosts) for _ in range(r.randrange(4))]
        rows.append((i, f"http://{src}/p?{i}", "".join(f'<a href="//{t}/x">{t}</a> <img src=https://{t}:8/>' for t in to), "clash"))
        for t in to:
            if t != src:
                edges[src, t] += 1
            edges[src, t + ":8"] += 1
    for host in {h for h in hosts if any(h in u for _, u, _, _ in rows)} | {v for _, v in edges}:
        labels = host.split(".")
        for j in range(len(labels) - 2):
            edges[".".join(labels[j:]), ".".join(labels[j + 1 :])] = 1 if j or (host, ".".join(labels[1:])) not in edges else edges[host, ".".join(labels[1:])]
    good, bad = {hosts[0]: 2.0, hosts[1]: 1.0}, {hosts[26]: 1.0, hosts[3]: 3.0}
    frame = lambda s: spark.createDataFrame(list(s.items()), "host string, weight double")
    trust, distrust = _walk(edges, good, 0.85), _walk({(v, u): w for (u, v), w in edges.items()}, bad, 0.85)
    got = url_filter.url_filter(table(rows, "page_id long, url string, html string, host string"), [], frame(good), frame(bad), threshold=0.8, tolerance=1e-9).collect()
    assert len(got) == 200
    for x in got:
        t, d = trust.get(x.host, 0.0), distrust.get(x.host, 0.0)
        assert x.trust == pytest.approx(t, abs=1e-6) and x.distrust == pytest.approx(d, abs=1e-6)
        assert x.verdict == ("block" if d > 0.8 * (t + d) else "allow")
    assert {x.verdict for x in got if x.host not in {**good, **bad}} == {"allow", "block"}


def test_url_rules_and_spread(spark, table):
    rows = [
        (1, "http://WWW.Example.com/en/7?x", ""), (2, "http://a.com/en/8", ""), (3, "http://other.com/de", '<a href="http://bad.org/x">'), (4, None, None), (5, "no host", ""), (6, "http://good.org#/en/", ""), (7, "x://com?/en/", ""), (8, "http://xcom/en/", ""), (8, "http://xcom/en/", ""),
        (9, "http://far.com/", '<p href="http://other.com/">' + "x" * 3_000_000),
    ]
    got = url_filter.url_filter(table(rows, "page_id long, url string, html string"), queries.RULES, _seeds(spark, good_org=1), _seeds(spark, bad_org=1)).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter([
        (1, "www.example.com", "/en/7", "example.com/en/7", "allow"), (2, "a.com", "/en/8", "com/en/", "block"), (3, "other.com", "/de", None, "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "good.org", "", None, "allow"), (7, "com", "", None, "allow"), (8, "xcom", "/en/", None, "allow"), (8, "xcom", "/en/", None, "allow"), (9, "far.com", "/", None, "block"),
    ])
    none = spark.createDataFrame([], "host string, weight double")
    assert url_filter.url_filter(table([], "page_id long, url string, html string"), queries.RULES, none, none).collect() == []


def test_url_rules_are_those_of_the_contract(spark, table):
    """net/de/ allows, though the host is distrusted, but for what a longer rule says."""
    rows = [(1, "http://bad.net/de/1", ""), (2, "http://www.example.net/de/81", ""), (3, "http://example.net/de/7", ""), (4, "http://bad.net/fr/", ""), (5, "http://good.org/es/", ""), (6, "http://good.com/en/7", "")]
    got = url_filter.url_filter(table(rows, "page_id long, url string, html string"), queries.RULES, _seeds(spark, good_org=1), _seeds(spark, bad_net=1)).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == [
        (1, "net/de/", "allow"), (2, "example.net/de/8", "block"), (3, "net/de/", "allow"), (4, None, "block"), (5, "org/es/", "block"), (6, "com/en/", "block")]


def test_distrust_reaches_hosts_many_links_away(spark, table):
    rows = [(i, f"http://h{i}.com/", f'<a href="http://h{i + 1}.com/">' if i < 39 else '<a href="http://bad.org/">') for i in range(40)]
    got = {r.page_id: (r.verdict, r.distrust) for r in url_filter.url_filter(table(rows, "page_id long, url string, html string"), [], _seeds(spark), _seeds(spark, bad_org=7)).collect()}
    mass = sum(0.85**i for i in range(41))
    assert got == {i: ("block", pytest.approx(0.85 ** (40 - i) / mass)) for i in range(40)}


def test_toxicity_with_repeated_and_contradictory_labels(spark, table):
    """The greatest label and the last text of a doc_id count, however rows are dealt; scores equal a plain loop over the fitted models."""
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["bad", "mean"] if i % 3 == 0 else ["kind", "plain"]) for _ in range(20)) + f" n{r.randrange(50)}") for i in range(90)]
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(i, 0) for i in range(0, 90, 2)] + [(5, None), (999, 1)]
    again = rows + [(3, "another text"), (None, "bad mean"), (200, None), (201, "bad " * 500_000)]
    run = lambda parts: {(x.doc_id, x.p_toxic, x.toxic) for x in toxicity.toxicity(table(again, "doc_id long, text string").repartition(parts, "doc_id"), table(labels, "doc_id long, toxic int"), {"low": "toxic", "toxic": "toxic"}).collect()}
    one, other = run(1), run(5)
    assert one == other and len(again) == len([x for x in one]) + 0
    flagged = {d: t for d, _, t in one}
    assert all(flagged[i] == (i % 3 == 0) for i in range(90) if i != 3) and flagged[200] is False
    known = {d: max(v for e, v in labels if e == d and v is not None) for d, _ in rows}
    texts = {d: max(t for e, t in again if e == d) for d, _ in rows}
    chain, cut = toxicity.fit_chain([toxicity.word_buckets([texts[d]])[0] for d in sorted(known)], np.array([[known[d]] * 2 for d in sorted(known)]), 192)
    for d, t in rows[:20]:
        held, p = set(toxicity.word_buckets([t])[0].tolist()), []
        for m in chain:
            z = m.bias + sum(w for b, w in zip(m.buckets.tolist(), m.weights.tolist()) if b in held) + sum(a * b for a, b in zip(p, m.dense.tolist()))
            p.append(1 / (1 + np.exp(-z)))
        assert any(x[0] == d and x[1] == pytest.approx(p[1], abs=1e-9) and x[2] == (p[1] >= cut) for x in one)


def test_quality_cuts_boilerplate_and_keeps_clean_texts(table):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + "\nshared line of the host", "s") for i in range(20)] + [(99, "few words", "s"), (100, "a b c " * 40, "s"), (101, "shared line of the host\n" * 30, "t")]
    docs = table(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in quality_rules.clean_documents(docs).collect()}
    assert set(kept) == set(range(20)) and all("shared" not in t and len(t.split()) == 60 for t in kept.values())


def test_pipeline_cuts_lines_that_a_tenth_of_a_large_host_holds(spark, table):
    line = "shared line of the host"
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + f"\n{line}" * (i % 10 == 0) + "\nonly ten texts hold this" * (i % 20 == 1 and i < 200), "s") for i in range(200)]
    docs = table(rows, "doc_id long, text string, source string")
    stage = dict(corpus_pipeline.STAGES)["quality"]
    kept = {r.doc_id: r.text for r in stage(spark, docs, None).collect()}
    assert kept == {d: t.replace(f"\n{line}", "") for d, t, _ in rows} and sum("only ten" in t for t in kept.values()) == 10
    got = {r.doc_id: r.n_line_words_removed for r in quality_rules.quality_rules(docs, share=0.0).collect()}
    assert got == {d: 5 * (line in t) for d, t, _ in rows}


def test_pipeline_against_brute_force(spark):
    """Each stage's own input and output by plain loops, over a whole small table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    path, texts = "/tmp/tablewright-pipeline", {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        texts[name] = before
    first = {r.doc_id: r for r in queries.op10_quality_rules(spark, DATA).collect()}
    assert set(texts["exact"]) == {d for d, r in first.items() if r.kept}
    best = {}
    for d, t in texts["exact"].items():
        best.setdefault("".join(words(t)), []).append((-len(t), d))
    assert set(texts["near"]) == {min(g)[1] for g in best.values()}
    assert set(texts["substring"]) == {c for _, _, c in _components(list(texts["near"].items()), 5, 80)}
    cut = {d: (n, t) for d, _, n, t in _substring(list(texts["substring"].items()), 35)}
    assert texts["packing"] == {d: (cut[d][1] if cut[d][0] else t) for d, t in texts["substring"].items() if cut[d][1] or not cut[d][0]}
    total = Counter()
    for r in docs.collect():
        total[r.doc_id] += r.length
    assert total == {d: len(x) for d, x in _pieces_of(texts["packing"].items()).items()}


def test_run_of_the_pipeline(spark, tmp_path):
    """run() over an empty table, over odd rows with more columns, and over rows of which the stages leave known ones."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, uid long, family long, _row long"
    text = lambda a, n=120: " ".join(f"{a}{i}" for i in range(n))
    passage = text("shared", 60)
    rows = [(1, text("a")), (2, text("a") + " "), (3, text("a", 121)), (4, text("b") + f"\n{passage}"), (5, text("c") + f"\n{passage}"), (6, None), (7, ""), (8, "few words"), (9, text("d")), (9, text("e")), (None, text("f"))]
    for name, data in (("empty", []), ("odd", [(d, t, None, "s", 0 if t is None else len(t), 0, 0, 0) for d, t in rows])):
        spark.createDataFrame(data, columns).repartition(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        total = Counter()
        for r in got:
            total[r.doc_id] += r.length
        want = [(2, text("a") + " "), (4, text("b")), (5, text("c")), (9, text("d")), (9, text("e")), (None, text("f"))]
        sizes = Counter()
        for i, (d, t) in enumerate(want):
            sizes[d] += len(_pieces_of([(i, t)])[i])
        assert total == (sizes if data else Counter())


def test_words():
    w = Words(["a  b\x0bc", None, "", "A b"], lower=True)
    assert np.diff(w.first).tolist() == [3, 0, 0, 2] and w.hash[0] == w.hash[3]


def test_a_stored_table_leaves_no_shuffle(spark):
    """The files of its query go at once, not when the driver collects its garbage."""
    names = lambda: {n for n in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before, setting = names(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    out = shared.store(spark.range(1000).repartition(8, "id"), "shuffled")
    for _ in range(40):
        left = {n for n in names() - before if n.endswith(".data") and os.path.exists(n)}
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(setting) == was and out.count() == 1000


def test_texts_are_shuffled_once_to_lose_their_repeats(spark, table):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = table([(1, f"a {passage} b", 1, {"x": 1}), (2, f"{passage} c", 2, None), (3, "only this", 3, {}), (4, None, 4, None), (5, "", 5, None), (6, passage, 6, None)], "doc_id long, text string, n_chars int, more map<string,int>")
    out = substring_dedup.drop_repeats(docs)
    exchanges = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert len(exchanges) == 2  # the texts and the spans
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b", 3, {"x": 1}), (2, "c", 1, None), (3, "only this", 3, {}), (4, None, 4, None), (5, "", 5, None)]
