import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.test_llm import ODD, WIDE, sha, wide, words

from tablewright.llm import periodic_runs, queries, suffix_dedup, whitening
from tablewright.llm.hashing import byte_minima


def _bytes_left(rows, least):
    """Rows in the order of their files; (doc_id, n, removed, spans, digest) by looking every window up."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        text = (rows[i][1] or "").encode()
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - least + 1):
            window = text[at : at + least]
            if window in seen:
                gone[at : at + least] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((rows[i][0], len(text), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def _got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("bound", [1 << 20, 400])
def test_suffix_dedup_against_brute_force(table, bound):
    r = random.Random(bound)
    base, rows = ["".join(r.choice("abcdeé") for _ in range(200)) for _ in range(4)], []
    for i in range(90):
        t = ""
        for _ in range(r.randrange(6)):
            at = r.randrange(180)
            t += r.choice([r.choice(base), r.choice(base)[at : at + r.randrange(1, 90)], "x" * r.randrange(90), "xy" * r.randrange(40), f"{r.random()}", "the same phrase"])
        rows.append((i * 7 % 101, t))
    rows += [*rows[:3], (None, rows[5][1]), (None, "alone"), (200, None), (201, "")]
    got = _got(suffix_dedup.suffix_dedup(table(rows, "doc_id long, text string"), 20, (10, 14, 17, 20), bound, 50))
    assert got == _bytes_left(rows, 20)


def test_a_common_string_in_unlike_places_is_parted_by_longer_anchors(table):
    """Windows round one string are over the bound, and unlike; some are copies all the same."""
    r, rows = random.Random(3), []
    for i in range(300):
        rows.append((i, f"{r.random():.17f}"[2:14] + "all rights reserved" + f"{r.random():.17f}"[2:14]))
    rows += [(1000 + i, rows[i * 50][1][5:38] + f"{i}") for i in range(5)]
    docs = table(rows, "doc_id long, text string")
    assert _got(suffix_dedup.suffix_dedup(docs, 28, (12, 20, 28), 2000)) == _bytes_left(rows, 28)


def test_suffix_dedup_of_odd_and_empty_tables(table):
    assert suffix_dedup.suffix_dedup(table([], WIDE)).collect() == []
    assert _got(suffix_dedup.suffix_dedup(table(wide(ODD), WIDE))) == _bytes_left(ODD, 100)


def test_suffix_dedup_of_very_long_texts(table):
    passage = "".join(random.Random(1).choices("abcdefgh ", k=5000))
    rows = [(1, "x" * 3_000_000), (2, passage * 40), (3, "y" + passage[:99]), (4, "y" + passage[:100] + "z"), (5, "xy" * 200_000), (6, "x" * 99), (7, passage * 2 + "end")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(table(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3_000_000, 2_999_999, 1), 2: (200_000, 195_000, 1), 3: (100, 0, 0), 4: (102, 101, 1), 5: (400_000, 399_998, 1), 6: (99, 0, 0), 7: (10_003, 10_000, 1)}


@given(st.lists(st.sampled_from(b"abc\xc3"), max_size=80).map(bytes), st.integers(8, 30))
@settings(max_examples=200, deadline=None)
def test_suffix_array_and_common_prefixes(text, depth):
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_dedup.suffix_array(text, len(text) + 8).tolist() == want
    got = suffix_dedup.suffix_array(text, depth)
    assert [text[i : i + depth] for i in got] == [text[i : i + depth] for i in want]
    for a, b, n in zip(got, got[1:], suffix_dedup.common_prefixes(text, got, depth)[1:]):
        assert text[a : a + n] == text[b : b + n] and (n == depth or a + n == len(text) or b + n == len(text) or text[a + n] != text[b + n])


def test_ties_of_copies_are_not_sorted_again_each_round(monkeypatch):
    rng, sort, sizes = np.random.default_rng(3), np.argsort, []
    text = rng.integers(97, 123, 5000, np.uint8).tobytes() * 4
    with monkeypatch.context() as m:
        m.setattr(np, "argsort", lambda a, *more, **named: (sizes.append(len(a)), sort(a, *more, **named))[1])
        got = suffix_dedup.suffix_array(text, 100)
    assert sum(sizes) < 2 * len(text)
    assert sorted(got.tolist()) == list(range(len(text)))
    assert [text[i : i + 100] for i in got] == sorted(text[i : i + 100] for i in range(len(text)))
    for most in (3, 100, 20_000):
        want = [next((k for k, (x, y) in enumerate(zip(text[a : a + most], text[b : b + most])) if x != y), min(most, len(text) - max(a, b))) for a, b in zip(got[:200], got[1:200])]
        assert suffix_dedup.common_prefixes(text, got[:200], most).tolist() == [0, *want]


@given(st.lists(st.lists(st.sampled_from(b"ab"), max_size=60).map(bytes), min_size=1, max_size=4), st.integers(8, 14), st.integers(0, 20))
@settings(max_examples=150, deadline=None)
def test_copies_of_a_window_share_an_anchor(texts, k, more):
    least, texts = k + more, [*texts, texts[0]]
    first = np.cumsum([0, *map(len, texts)])
    raw = b"".join(texts)
    keys = dict(zip(*(x.tolist() for x in byte_minima(raw, first, least, k))))
    met = {}
    for a, b in zip(first, first[1:]):
        for i in range(a, b - least + 1):
            met.setdefault(raw[i : i + least], set()).add(min(keys[p] for p in range(i, i + least - k + 1) if p in keys))
    assert all(len(found) == 1 for found in met.values())


def test_copies_that_overlap_have_anchors_of_their_own():
    """Periodic stretches over all borders of blocks: the key of a window that starts twice has two places."""
    r = random.Random(12)
    raw = b"".join(bytes(r.choices(b"abcdefgh", k=r.randrange(1, 60))) * r.randrange(1, 30) for _ in range(200))
    at, key = byte_minima(raw, np.array([0, len(raw)]), 100, 40)
    keys, places = dict(zip(at.tolist(), key.tolist())), Counter(key.tolist())
    starts = {}
    for i in range(len(raw) - 99):
        starts.setdefault(raw[i : i + 100], []).append(i)
    assert len(raw) > 40_000
    for found in starts.values():
        if len(found) > 1:
            assert places[min(keys[p] for p in range(found[0], found[0] + 61) if p in keys)] > 1


def _runs(w, least):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(least, 2 * p):
                found.setdefault((s, i - s + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda x: (x[0], x[2]))


def _collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 7), st.integers(2, 12))
@settings(max_examples=300, deadline=None)
def test_runs_of_numbers(values, again, least):
    values = values + (values * again)[: 20 * again] + values[:9]
    assert periodic_runs.find_runs(np.array(values), least) == _runs(values, least)


def test_longest_previous_factors():
    r = random.Random(2)
    for _ in range(200):
        t = [r.randrange(2) for _ in range(r.randrange(1, 40))]
        s = periodic_runs.Substrings(np.array(t))
        order = s.suffix_array()
        length, source = periodic_runs.previous_factors(order, np.concatenate([[0], s.forward(order[:-1], order[1:])]))
        for i in range(len(t)):
            want = max((next((n for n in range(len(t) - i) if t[i + n] != t[j + n]), len(t) - i) for j in range(i)), default=0)
            assert length[i] == want and (not want or source[i] < i and t[i : i + want] == t[source[i] : source[i] + want])


def test_periodic_runs_against_brute_force(table):
    r, rows = random.Random(6), []
    for i in range(120):
        w = []
        for _ in range(r.randrange(4)):
            part = [f"w{r.randrange(40)}" for _ in range(r.randrange(1, 15))]
            w += r.choice([part, part * r.randrange(1, 6), part * 2 + part[: len(part) // 2], ["a"] * r.randrange(30), ["a", "b"] * r.randrange(12) + ["a"]])
        rows.append((i, r.choice([" ", "\n ", "\t"]).join(w)))
    rows += [*ODD, (99, rows[0][1])]
    got = Counter((x.doc_id, x.n_words, tuple(tuple(q) for q in x.runs), x.collapsed_text) for x in periodic_runs.periodic_runs(table(wide(rows), WIDE), chunk_bytes=500).collect())
    want = Counter()
    for d, t in rows:
        w = words(t)
        runs = _runs(w, 12) if d != 6 or t != ODD[7][1] else [(0, 27_000, 3)]
        want[d, len(w), tuple(runs), _collapsed(w, runs)] += 1
    assert got == want
    assert periodic_runs.periodic_runs(table([], WIDE)).collect() == []


def test_runs_of_very_long_texts(table):
    rows = [(1, "a " * 400_000), (2, " ".join(f"w{i % 5000}" for i in range(20_000))), (3, "x" * 2_000_000), (4, " ".join(f"w{i}" for i in range(200_000)))]
    got = {r.doc_id: [tuple(q) for q in r.runs] for r in periodic_runs.periodic_runs(table(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(0, 400_000, 1)], 2: [(0, 20_000, 5000)], 3: [], 4: []}


def test_op13_query_against_brute_force(spark, tmp_path):
    r, rows = random.Random(8), []
    for i in range(400):
        rows.append((i, " ".join(r.choice(["a", "b", f"w{r.randrange(30)}"]) for _ in range(r.choice([0, 1, 5, 40, 90])))))
    rows += [(400, None), (None, "a " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: tuple(x)[2:] for x in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for d, t in rows:
        w, h = words(t), zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if d is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = _runs(w, 12)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else None
        assert got[d] == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(_collapsed(w, runs)))
    assert planted > 20


def _white(rows, k=4):
    """By the covariance's own eigenvectors."""
    good = [(i, np.array([np.floor(256 * float(c)) for c in v])) for i, v in rows if v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in good]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    out = {}
    for i, x in good:
        for j in range(min(k, 6)):
            v, e = vectors[:, -1 - j], values[-1 - j]
            out.setdefault((i, j + 1), []).append((n, int(((n * x - sums) ** 2).sum()), abs(float((x - sums / n) @ v / np.sqrt(e))), e / values.sum()))
    return out


def test_whitening_against_brute_force(spark, table):
    r = np.random.default_rng(4)
    mix = r.normal(size=(6, 6)) * [1, 2, 3, 4, 5, 6]
    rows = [(i, (r.normal(size=6) @ mix / 20).tolist()) for i in range(500)]
    rows += [(600 + i, rows[7][1]) for i in range(200)] + [rows[3], (None, rows[9][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] * 6), (905, [float("inf")] * 6), (906, [float("-inf")] * 6)]
    got = whitening.whitening(table(rows, "vec_id long, embedding array<double>", 7)).collect()
    want = _white(rows)
    assert len(got) == sum(map(len, want.values())) and {(g.vec_id, g.component) for g in got} == set(want)
    for g in got:
        w = want[g.vec_id, g.component][0]
        assert (g.n, g.deviation) == w[:2] and abs(g.whitened) == pytest.approx(w[2], abs=1e-9) and g.explained == pytest.approx(w[3]) and g.identity_error < 1e-9
    one = {g.component: g.whitened for g in got if g.vec_id == 7}
    assert all(g.whitened == one[g.component] for g in got if g.vec_id is not None and 600 <= g.vec_id < 800)


def test_summaries_merge_without_loss():
    r = np.random.default_rng(1)
    x = r.integers(-300, 300, (1000, 8))
    whole = whitening.Summary.of(x)
    parts, at = None, 0
    for n in (1, 1, 3, 200, 795):
        part = whitening.Summary.of(x[at : at + n])
        parts, at = part if parts is None else parts.merge(part), at + n
    assert parts.n == 1000 and (parts.sums == whole.sums).all() and np.allclose(parts.scale, whole.scale, rtol=1e-12)
    assert np.allclose(parts.eigen()[1], whole.eigen()[1], atol=1e-9)


def test_whitening_of_few_vectors(table):
    kind = "vec_id long, embedding array<float>, n long"
    assert whitening.whitening(table([], kind)).collect() == []
    assert whitening.whitening(table([(1, [0.5, 1.0], 0)] * 3, kind)).collect() == []
    got = whitening.whitening(table([(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0], 0)], kind)).collect()
    assert sorted((g.vec_id, g.component, g.n, g.deviation, round(g.whitened, 9), g.explained) for g in got) == [(1, 1, 2, 256 * 256, -1.0, 1.0), (2, 1, 2, 256 * 256, 1.0, 1.0), (2, 1, 2, 256 * 256, 1.0, 1.0)]


def test_deviation_is_exact_beyond_64_bits():
    x = np.array([[1 << 40, 3], [1, -(1 << 20)]])
    got = whitening._deviation(x, 10**6, np.array([5, 7]))
    want = [sum((10**6 * int(v) - s) ** 2 for v, s in zip(row, (5, 7))) for row in x]
    assert got == [v if v < 1 << 63 else None for v in want] and None in got


def test_op10_rejects_documents_that_its_lines_deplete(spark, tmp_path):
    """The query itself: a footer that eleven texts of a host hold is cut, and what is then under half is rejected."""
    footer = " ".join(f"footer{i}" for i in range(60))
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, f"{own(i, 20 if i < 4 else 70)}\n{footer}", "h") for i in range(11)] + [(20 + i, f"{own(20 + i, 20)}\n{footer}", "g") for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.base_failed, r.kept) for r in queries.op10_quality_rules(spark, str(tmp_path)).collect()}
    assert got == {d: (False, d >= 4) for d, _, _ in rows}
