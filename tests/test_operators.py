import difflib
import hashlib
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import neardup, registry, runs, sampling, synthetic
from tablewright.operators.items import model_inputs, normalise, raw_violation, source_path
from tablewright.sources import json_files



def test_allocation_is_exact_and_fair(spark):
    r = random.Random(1)
    for _ in range(6):
        sizes = [(f"g{i:02d}", r.randrange(1, 140)) for i in range(r.randrange(1, 22))]
        total = sum(n for _, n in sizes)
        target = r.randrange(total + 1)
        got = {x["name"]: x.allocated for x in sampling.allocate(spark.createDataFrame(sizes, "name string, n long"), F.lit(target)).collect()}
        floors = {k: n * target // total for k, n in sizes}
        rest = sorted(sizes, key=lambda g: (-(g[1] * target / total - floors[g[0]]), g[0]))[: target - sum(floors.values())]
        assert got == {k: floors[k] + (k in dict(rest)) for k, _ in sizes} and sum(got.values()) == target


def test_targets():
    assert sampling.ratio_targets(350, 0.25, 0.30) == (62, 26)
    assert sampling.ratio_targets(346, 0.25, 0.0, has_full=False) == (86, 0)


def _score(later, earlier):
    words = lambda x: set(re.findall(r"\w+", x))
    if not later or not earlier:
        return 0.0
    a, b = words(later), words(earlier)
    return max(difflib.SequenceMatcher(None, later, earlier).ratio(), len(a & b) / len(a | b) if a | b else 1.0)


@pytest.mark.parametrize("threshold", [0.8, 0.95])
def test_greedy_near_duplicates(spark, threshold):
    r = random.Random(4)
    base = ["warm soup with rice and beans", "cold noodle salad", "a cake", ""]
    texts = []
    for _ in range(70):
        t = list(r.choice(base))
        for _ in range(r.randrange(4)):
            if t:
                t[r.randrange(len(t))] = r.choice("abc ")
        texts.append(re.sub(r"\s+", " ", "".join(t)).strip())
    blocks = [r.random() < 0.8 for _ in texts]
    for use in (False, True):
        stays, want = [], []
        for i, t in enumerate(texts):
            close = [j for j in stays if _score(t, texts[j]) >= threshold]
            want.append(bool(close))
            if not close and (blocks[i] or not use):
                stays.append(i)
        rows = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(zip(texts, blocks))], "pos long, t string, b boolean")
        got = {x.pos: x.near_duplicate_of is not None for x in neardup.greedy_keep(rows, F.col("t"), "pos", threshold, F.col("b") if use else None).collect()}
        assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("threshold,lengths,hot", [(0.8, (1, 2, 5, 9, 30, 60), 10_000), (0.97, (40, 80), 60), (0.995, (120, 220, 450), 10_000)])
def test_near_pairs_against_all_pairs(spark, threshold, lengths, hot, monkeypatch):
    r, texts = random.Random(5), set()
    base = ["".join(r.choice("abc de") for _ in range(n)) for n in lengths]
    for _ in range(100):
        t = list(r.choice(base))
        for _ in range(r.randrange(5)):
            i = r.randrange(len(t) + 1)
            t[i : i + r.randrange(2)] = r.choice(["", "x", "y "])
        texts.add(re.sub(" +", " ", "".join(t)).strip())
    texts = sorted(texts - {""})
    r.shuffle(texts)
    keys = spark.createDataFrame(list(enumerate(texts)), "node long, key string")
    monkeypatch.setattr(neardup, "HOT", hot)
    got = {(x.earlier, x.later) for x in neardup.near_pairs(keys, threshold).collect()}
    assert got == {(i, j) for j in range(len(texts)) for i in range(j) if _score(texts[j], texts[i]) >= threshold}


def test_ten_thousand_keys_with_one_common_stretch_make_few_candidates(spark):
    """Two thirds of each key are the same words; only the rest tells near copies."""
    r = random.Random(2)
    common = "could you please find me some warm dish that a friend of mine would like to have on a cold winter evening after work " * 2
    keys = [common + "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(120)) for _ in range(10_000)]
    keys += [k + "s" for k in keys[:50]]
    found = neardup.edit_candidates(spark.createDataFrame(list(enumerate(keys)), "node long, key string"), 0.995).distinct().collect()
    pairs = {tuple(sorted((x.x, x.y))) for x in found}
    assert {(i, 10_000 + i) for i in range(50)} <= pairs and len(pairs) < 20_000


def test_losers_of_a_chain_and_of_a_random_graph(spark):
    """A chain as long as its graph is decided in few rounds, whatever fits in one task."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(5000)], "earlier long, later long")
    for bound, most in ((1 << 20, 1), (1000, 8)):
        rounds = []
        assert {x.node for x in neardup.losers(chain, bound, rounds).collect()} == set(range(1, 5001, 2)) and len(rounds) <= most
    r = random.Random(3)
    edges = {tuple(sorted(r.sample(range(300), 2))) for _ in range(700)}
    stays = set()
    for v in range(300):
        if not any((u, v) in edges for u in stays):
            stays.add(v)
    graph = spark.createDataFrame(sorted(edges), "earlier long, later long")
    for bound in (1 << 20, 150):
        assert {x.node for x in neardup.losers(graph, bound).collect()} == set(range(300)) - stays
    assert neardup.losers(graph.limit(0)).collect() == []


def test_large_samples_by_hash_sort_nothing(spark):
    """Half of a table, with repeated and null keys, by digits of the hash; equal to sorting everything."""
    keys = [str(i % 3000) for i in range(6000)] + ["again"] * 900 + [None] * 300
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    order = sorted((k for k in keys if k), key=lambda k: hashlib.sha256(f"7:{k}".encode()).hexdigest()) + [None] * 300
    for limit in (1, 3450, 6899, 6900, 7100, 7200, 9000):
        for small in (50, 0):
            got = sampling.hash_sample(rows, F.col("k"), limit, 7, small)
            assert Counter(r.k for r in got.collect()) == Counter(order[:limit])
    plan = sampling.hash_sample(rows, F.col("k"), 3450, 7, 0)._jdf.queryExecution().toString()
    assert "Window" not in plan and sampling.hash_sample(rows, F.col("k"), 0).count() == 0


@pytest.mark.parametrize("files", [1, 7])
def test_exact_shuffle_of_numbers_alone(spark, files):
    rows = [(f"k{i:04d}", None if i % 5 == 4 else f"s{i * i % 7}", (i * 37) % 1000) for i in range(1000)]
    want = {}
    for name in {s for _, s, _ in rows}:
        keys = [k for _, k in sorted((p, k) for k, s, p in rows if s == name)]
        random.Random(int(hashlib.sha256(f"1508:{name}".encode()).hexdigest()[:16], 16)).shuffle(keys)
        want |= {(k, name): i + 1 for i, k in enumerate(keys)}
    ranked = sampling.ranked_exact(spark.createDataFrame(rows, "k string, s string, p long").repartition(files), "k", "s", "p")
    assert {(r.k, r.s): r["rank"] for r in ranked.collect()} == want
    assert "FlatMapGroupsInPandas" not in ranked._jdf.queryExecution().toString()


def test_approve_full_names_the_first_reason(spark):
    good = {"single_answer_validity": 1.0, "distractor_plausibility": 1.0, "distribution_fit_score": 1.0, "language_quality": 1.0, "leakage_risk": 0.0}
    rows = [
        (0, "a", "one query here", ["x", "y"], ["s1"], "approved", good), (1, "b", "one query here!", ["x", "y"], ["s1"], "approved", good), (2, "c", "other words", ["x", "X "], ["s1"], "approved", good),
        (3, "d", "other words", ["x", "y"], ["s1"], "approved", good), (4, "e", "third", ["x", "y"], ["s9"], "approved", good), (5, "f", "fourth", ["x"], ["s1"], "pending", good),
        (6, "g", "fifth", ["x"], ["s1"], "approved", {**good, "leakage_risk": 0.21}), (7, "h", "known", ["x"], ["s1"], "approved", good), (8, "i", "sixth", ["x"], ["s1"], "approved", {"leakage_risk": 0.0}),
    ]
    df = spark.createDataFrame(rows, "pos long, example_id string, query string, options array<string>, seed_example_ids array<string>, review_status string, review_scores map<string,double>")
    items = spark.createDataFrame([("s1", "Known."), ("s2", "else")], "example_id string, query string")
    got = {r.example_id: r.reason for r in synthetic.approve_full(df, items, items).collect()}
    assert got == {"a": None, "b": "near_duplicate_to_approved", "c": "duplicate_option_texts", "d": None, "e": "seed_not_in_train", "f": "review_not_approved", "g": "high_leakage_risk", "h": "exact_duplicate_to_authentic", "i": "low_single_answer_validity"}


def test_generation_with_a_fake_provider(spark):
    ask = spark.createDataFrame([("p1", "fail"), ("p2", "ok")], "example_id string, payload string")

    def client():
        def reply(text):
            if text == "fail":
                raise ValueError("no")
            return {"queries": [text]}

        return reply

    got = {r.example_id: (r.reply, r.error) for r in synthetic.call_provider(ask, client).collect()}
    assert got == {"p1": (None, "no"), "p2": ('{"queries": ["ok"]}', None)}
    replies = spark.createDataFrame([("p1", 0, 0, "New one"), ("p1", 0, 1, "known"), ("p1", 0, 2, "new one!"), ("p1", 0, 3, "Two"), ("p2", 1, 0, "two"), ("p2", 1, 1, "")], "parent_example_id string, parent_pos int, candidate_pos int, query string")
    items = spark.createDataFrame([("x", "Known")], "example_id string, query string")
    assert sorted((r.example_id, r.query) for r in synthetic.number_candidates(replies, items).collect()) == [("p1-sq-01", "New one"), ("p1-sq-02", "Two")]
    explained = spark.createDataFrame([('{"a": " x ", "b": ["y", "z"]}',), ('[{"key": "a", "value": "1"}, {"key": "a", "value": "2"}]',)], "e string")
    assert [r[0] for r in explained.select(synthetic.explanation_map(F.col("e"))).collect()] == [{"a": ["x"], "b": ["y", "z"]}, {"a": ["2"]}]


def test_registry(spark):
    schema = "entry_id string, run_id string, stage string, status string, created_at string, updated_at string"
    old = spark.createDataFrame([("a", "a", "baseline", "running", "2024-01-02", ""), ("b", "b", "candidate", "failed", "2024-01-01", "")], schema)
    new = spark.createDataFrame([("a", "a", "baseline", "completed", "2024-01-03", "")], schema)
    now = registry.upsert(old, new)
    assert [(r.entry_id, r.status) for r in now.collect()] == [("b", "failed"), ("a", "completed")]
    assert registry.listed(now, status="failed", stage=None).count() == 1
    assert registry.promote(now, "a", "validated", "now").where("stage = 'validated' and updated_at = 'now'").count() == 1
    with pytest.raises(ValueError):
        registry.promote(now, "a", "nowhere", "now")
    assert registry.text_table([{"a": 1, "b": None}], ["a", "b"]) == "a  b\n-  ----\n1  None"


def test_raw_records(spark, tmp_path):
    flags = {"Specific": 1, "Commonsense": 0, "Negated": 0, "Analogical": 0, "Temporal": 1}
    record = {"query": " soup\t", "query_type": flags, "options": {f"o{i}": f"t{i}" for i in range(5)}, "answer": "o0", "correctness_explanation": {"k": ["v"]}}
    faults = [record, {**record, "query": " "}, {**record, "answer": "none"}, {**record, "options": {"o0": "x"}}, {**record, "query_type": {"Specific": 1}}, {k: v for k, v in record.items() if k != "answer"}]
    (tmp_path / "raw.json").write_text(json.dumps(faults))
    raw = json_files.read_raw(spark, str(tmp_path / "raw.json"))
    bad = raw_violation(F.col("query"), F.col("query_type"), F.col("options"), F.col("answer"), F.col("correctness_explanation"))
    got = [r.v for r in raw.select("pos", bad.alias("v")).orderBy("pos").collect()]
    assert got == [None, "query must be a non-empty string", "answer must match one option id", "must contain exactly 5 options", "query_type keys", "missing keys"]
    first = normalise(raw.where("pos = 0"), "raw.json").first()
    assert (first.example_id, first.query, first.options[4].text) == ("rmpr-0001", "soup", "t4")
    assert first.source_metadata.asDict() == {"raw_dataset_path": "raw.json", "raw_index": 0, "normalization": ["strip_query_outer_whitespace"]}
    assert json_files.read_registry(spark, str(tmp_path / "absent")).count() == 0
    manifest = {"metadata": {}, "splits": {"train": ["a", "b"], "odd": ["b"]}}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    rows = json_files.read_manifest(spark, str(tmp_path / "m.json"))
    assert sorted(tuple(r) for r in rows.collect()) == [("odd", 0, "b"), ("train", 0, "a"), ("train", 1, "b")]
    assert sorted(tuple(r) for r in json_files.manifest_violation(rows).collect()) == [("id in two places", "b"), ("unknown split", "odd")]


def test_raw_flags_and_explanations(spark, tmp_path):
    """Truth values and numbers are flags; explanations are texts or lists, and go along as they are."""
    types = ("Specific", "Commonsense", "Negated", "Analogical", "Temporal")
    record = lambda flags, why: {"query": "soup", "query_type": dict(zip(types, flags)), "options": {f"o{i}": f"t{i}" for i in range(5)}, "answer": "o0", "correctness_explanation": why}
    why = {"z": "text é", "a": ["one", "two"]}
    rows = [
        (record([True, False, 1, 0, 1.0], why), None), (record([True, False, 1, 0, "1"], why), "query_type must be boolean-like"), (record([True, False, 1, 0, None], why), "query_type must be boolean-like"),
        (record([0, 0, 0, 0, 2], why), "query_type must be boolean-like"), (record([0] * 5, {}), "explanation must be a non-empty mapping"), (record([0] * 5, {"a": []}), "explanation values must be non-empty"),
        (record([0] * 5, {"a": [" "]}), "explanation values must be non-empty"), (record([0] * 5, {"a": 3}), "explanation values must be non-empty"), (record([0] * 5, {" ": "x"}), "explanation keys must be non-empty"), (record([0] * 5, None), "missing keys"),
    ]
    (tmp_path / "raw.json").write_text(json.dumps([r for r, _ in rows]))
    raw = json_files.read_raw(spark, str(tmp_path / "raw.json"))
    bad = raw_violation(*map(F.col, ("query", "query_type", "options", "answer", "correctness_explanation")))
    assert [r.v for r in raw.select("pos", bad.alias("v")).orderBy("pos").collect()] == [v for _, v in rows]
    json_files.write_lines(normalise(raw.where("pos = 0"), "raw.json"), str(tmp_path / "items"))
    again = json.loads(spark.read.text(str(tmp_path / "items")).first()[0])
    assert again["correctness_explanation"] == why and list(again["correctness_explanation"]) == ["z", "a"]
    assert again["query_type_flags"] == dict(zip(types, (True, False, True, False, True))) and again["source_metadata"]["raw_index"] == 0


def test_exact_shuffles_equal_the_standard_library(spark):
    """Splits and samples held to a plain shuffle of each stratum, seeded by its digest."""
    rows = [(i, f"id{i}", "abcd"[(i * i) % 7 % 4]) for i in range(203)]
    df = spark.createDataFrame(rows, "pos long, id string, s string").repartition(5)
    order = {}
    for s in "abcd":
        order[s] = [i for _, i, t in rows if t == s]
        random.Random(int(hashlib.sha256(f"1508:{s}".encode()).hexdigest()[:16], 16)).shuffle(order[s])

    def shares(sizes, target):
        exact = {s: n * target / sum(sizes.values()) for s, n in sizes.items()}
        got = {s: int(x) for s, x in exact.items()}
        for s in sorted(sizes, key=lambda s: (got[s] - exact[s], s))[: target - sum(got.values())]:
            got[s] += 1
        return got

    sizes = {s: len(x) for s, x in order.items() if x}
    train = shares(sizes, int(203 * 0.7))
    validation = shares({s: n - train[s] for s, n in sizes.items()}, int(203 * 0.15))
    want = {i: "train" if n < train[s] else "validation" if n < train[s] + validation[s] else "test" for s, ids in order.items() for n, i in enumerate(ids)}
    split = sampling.split_exact(df, "id", "s", "pos")
    assert {r.id: r.split for r in split.collect()} == want
    part = shares(sizes, 40)
    assert {r.id for r in sampling.stratified_sample_exact(df, "id", "s", "pos", 40).collect()} == {i for s, ids in order.items() for i in ids[: part.get(s, 0)]}
    assert sampling.stratified_sample_exact(df, "id", "s", "pos", 1000).count() == 203
    with pytest.raises(ValueError):
        sampling.stratified_sample_exact(df, "id", "s", "pos", -1)
    # golden values of one stratum
    assert order["a"][:3] == [r.id for r in sampling.ranked_exact(df, "id", "s", "pos").where("s = 'a'").orderBy("rank").limit(3).collect()]
    made = json.loads(sampling.manifest(split.join(df.select("id", "pos"), "id"), "id", "s", "pos").toJSON().first())
    assert {n: made["splits"][n] for n in ("train", "validation", "test")} == {n: [i for _, i, _ in rows if want[i] == n] for n in ("train", "validation", "test")}
    assert made["metadata"]["counts"] == dict(Counter(want.values())) and made["metadata"]["ratios"] == {"train": 0.7, "validation": 0.15, "test": 0.15} and made["metadata"]["seed"] == 1508
    assert made["metadata"]["query_type_signature_counts"]["test"] == dict(sorted(Counter(s for _, i, s in rows if want[i] == "test").items()))


def test_ranks_by_hash(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(500)] + [(1000, None)]
    got = sampling.ranked_by_hash(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()
    want = {}
    for s in ("a", "b", None):
        for n, (_, i) in enumerate(sorted((hashlib.sha256(f"1508:{i}".encode()).hexdigest(), i) for i, t in rows if t == s)):
            want[i] = n + 1
    assert {r.id: r["rank"] for r in got} == want


def test_predictions_and_results(spark, tmp_path):
    full = {"run_id": "r", "phase": "p", "provider": "v", "model_name": "m", "split": "test", "example_id": "e1", "prompt_version": "1", "raw_response": "é A", "parsed_choice": "A", "predicted_option_id": "o", "gold_option_id": "o", "is_correct": True, "latency_ms": 1.5, "metadata": {"t": 0}}
    short = {k: v for k, v in full.items() if k not in ("parsed_choice", "predicted_option_id", "latency_ms", "metadata")} | {"example_id": "e2"}
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, (full, short))))
    rows = json_files.read_predictions(spark, str(tmp_path / "p.jsonl"))
    json_files.write_predictions(rows, str(tmp_path / "out"), ["example_id"])
    again = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert again == [full, {**short, "parsed_choice": None, "predicted_option_id": None, "latency_ms": None, "metadata": {}}]
    (tmp_path / "bad.jsonl").write_text(json.dumps({k: v for k, v in full.items() if k != "gold_option_id"}))
    with pytest.raises(Exception, match="gold_option_id is missing"):
        json_files.read_predictions(spark, str(tmp_path / "bad.jsonl")).collect()
    result = {"model": "a/b", "split": "test", "metrics": {"overall": 0.5, "total_correct": 1, "total": 2}}
    (tmp_path / "one.json").write_text(json.dumps(result))
    (tmp_path / "two.json").write_text(json.dumps({**result, "eval_mode": "loglikelihood"}))
    got = json_files.read_results(spark, [str(tmp_path / "one.json"), str(tmp_path / "absent*.json"), str(tmp_path / "two.json")]).collect()
    assert sorted((r.file, r.eval_mode) for r in got) == [("one.json", "generative"), ("two.json", "loglikelihood")]
    assert json_files.read_results(spark, str(tmp_path / "absent.json")).collect() == []
    (tmp_path / "one.json").write_text(json.dumps({**result, "metrics": {"overall": 0.5, "total": 2}}))
    with pytest.raises(Exception, match="total_correct is missing"):
        json_files.read_results(spark, str(tmp_path / "one.json")).collect()
    assert json_files.read_config(str(tmp_path / "absent.json")) == {} and json_files.read_config(str(tmp_path / "two.json"))["split"] == "test"


def test_nested_full_records_and_run_manifests(spark, tmp_path):
    flags = {"Specific": True, "Commonsense": False, "Negated": False, "Analogical": False, "Temporal": True}
    item = {"example_id": "s1", "query": "q", "options": [{"option_id": f"o{i}", "text": f"t{i}"} for i in range(5)], "answer_option_id": "o0", "query_type_flags": flags, "correctness_explanation": {"k": "v", "l": ["a", "b"]}, "source_metadata": {"raw_index": 3, "steps": ["a"]}}
    made = {"synthetic_mode": "full_generation", "generator_model": "m", "review_status": "pending", "review_scores": {"a": 0.5}, "seed_example_ids": ["e1"], "distractor_generation_method": "d", "distribution_fit_score": 0.25}
    (tmp_path / "full.jsonl").write_text(json.dumps({"recipe_example": item, "provenance": made}))
    rows = json_files.read_full(spark, str(tmp_path / "full.jsonl"))
    got = rows.first()
    assert (got.example_id, got.options[4].text, got.correctness_explanation, got.seed_example_ids, got.review_scores, got.distribution_fit_score) == ("s1", "t4", {"k": ["v"], "l": ["a", "b"]}, ["e1"], {"a": 0.5}, 0.25)
    json_files.write_nested_full(rows, str(tmp_path / "nested"))
    json_files.write_lines(rows, str(tmp_path / "flat"))
    again = [json_files.read_full(spark, str(tmp_path / p)).first() for p in ("nested", "flat")]
    plain = lambda r: {**r.asDict(recursive=True), "source_metadata": json.loads(str(r.source_metadata))}
    assert plain(again[0]) == plain(again[1]) == plain(got) and plain(got)["source_metadata"] == item["source_metadata"]
    assert runs.read_manifests(spark, str(tmp_path)).collect() == []
    for name in ("b", "a"):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "run_manifest.json").write_text(json.dumps({"run_id": name, "run_type": "eval", "metrics": {"overall": 0.5}, "command": ["x"]}, indent=2))
    assert [(r.run_id, r.command) for r in runs.read_manifests(spark, str(tmp_path)).collect()] == [("a", ["x"]), ("b", ["x"])]
    ref, = runs.artifact_refs(spark, {"f": str(tmp_path / "full.jsonl")})
    assert ref["sha256"] == hashlib.sha256((tmp_path / "full.jsonl").read_bytes()).hexdigest() and ref["size_bytes"] == (tmp_path / "full.jsonl").stat().st_size


def test_model_inputs_and_paths(spark, tmp_path):
    df = spark.createDataFrame([("e", "o", 1)], "example_id string, option_id string, label int")
    got = model_inputs(df, F.struct(F.array(F.lit(5)).alias("input_ids"), F.lit("x").alias("option_id"))).first()
    assert got.asDict() == {"example_id": "e", "option_id": "o", "label": 1, "input_ids": [5]}
    assert source_path(str(tmp_path / "a" / "b.json"), str(tmp_path)) == "a/b.json" and source_path("/else/c.json", str(tmp_path)) == "/else/c.json"


def test_stream(spark, tmp_path):
    from tests.conftest import DATA

    from tablewright.streaming.registry_stream import event_stream, status_counts

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    q = status_counts(event_stream(spark, str(tmp_path / "e"), events.schema)).writeStream.outputMode("update").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == events.count()
