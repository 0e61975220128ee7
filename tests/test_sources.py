"""Arrays read by byte ranges, and flattening at any depth."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tablewright.sources import json_files


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def odd_text(r):
    return "".join(r.choice(['"', "\\", "}", "{", "[", "]", ",", "é", "\n", "ab", "\\\"", "▁", " "]) for _ in range(r.randrange(40)))


@pytest.mark.parametrize("indent", [None, 2])
def test_array_by_ranges_equals_whole_file(spark, tmp_path, small_ranges, indent):
    """Strings full of quotes, escapes and braces; nested objects; ranges that start anywhere."""
    r = random.Random(indent or 0)
    files = {}
    for name in ("a.json", "b.json"):
        rows = [{"id": i, "t": odd_text(r), "in": {"x": {"y": odd_text(r)}, "l": [{"z": odd_text(r)}, 1, None]}, "e": {}} for i in range(120)]
        files[name] = rows
        (tmp_path / name).write_text(json.dumps(rows, indent=indent, ensure_ascii=r.random() < 0.5))
    path = str(tmp_path / "*.json")
    assert spark.read.text(path, lineSep="}").rdd.getNumPartitions() > 20
    got = {name: {} for name in files}
    for row in json_files.read_array(spark, path).collect():
        got[row.file.rsplit("/", 1)[1]][row.pos] = json.loads(row.record)
    assert got == {name: dict(enumerate(rows)) for name, rows in files.items()}


def test_arrays_that_are_none(spark, tmp_path):
    """Empty arrays and files have no records; what is broken off, or not of objects, fails."""
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.json"
        path.write_text(text)
        return [json.loads(x.record) for x in json_files.read_array(spark, str(path)).orderBy("pos").collect()]

    assert read("[]") == read(" [\n ] ") == read("") == []
    assert read('[{}]') == [{}] and read(' [ {"a": "}"} , {"b": {}} ] ') == [{"a": "}"}, {"b": {}}]
    for text in ('[{"a": 1}', '[{"a": 1}, {"b": ', '[{"a": "x', '[{"a": 1} {"b": 2}]', '[{"a": 1},]', '[1, {"a": 1}]', '{"a": 1}', '[{"a": 1}] x', "[", '[{"a": 1}]]'):
        with pytest.raises(Exception, match="not an array of objects"):
            read(text)


def _flat(value, name=""):
    for k, v in value.items():
        at = f"{name}.{k}" if name else k
        if isinstance(v, dict):
            yield from _flat(v, at)
        elif v is not None and not isinstance(v, list):
            yield at, (str(v).lower() if isinstance(v, bool) else str(v)), (float(v) if isinstance(v, (bool, int, float)) else None)


def test_scalars_at_any_depth(spark):
    objects = [
        {"a": {"b": {"c": {"d": {"e": "deep", "n": 7}}}}, "x": True, "no": None, "l": [1, {"a": 2}], "z": {}}, {}, {"brace": "{not an object}", "list": "[nor a list]", "q": 'a"}\\"{'},
        {"": 1, "s": {"": 2.5, "t": False, "u": {"v": -3}}, "empty": "", "long": "x" * 100_000}]
    rows = [(i, json.dumps(o)) for i, o in enumerate(objects)] + [(7, None), (8, "3"), (9, "[1]"), (10, '"{"'), (11, "null")]
    df = spark.createDataFrame(rows, "id long, j string").select("id", F.parse_json("j").alias("v"), F.lit(1).alias("name"), F.lit(2).alias("key"))
    want = sorted((i, *x) for i, o in enumerate(objects) for x in _flat(o) if x[0] not in ("", "s."))
    got = json_files.flat_scalars(df, "id", "v")
    assert sorted((r.id, r["name"], r.value, r.number) for r in got.collect() if r["name"] not in ("", "s.")) == want
    assert {(r["name"], r.value) for r in got.collect() if r["name"] in ("", "s.")} == {("", "1"), ("s.", "2.5")}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert json_files.flat_scalars(df.limit(0), "id", "v").collect() == []
    assert {r["name"] for r in json_files.flat_scalars(df, "id", "v", depth=1).collect()} == {"x", "brace", "list", "q", "", "empty", "long"}


def test_scalars_read_a_variant_once_and_open_no_lists(spark):
    text = F.concat(F.lit('{"a": {"l": [[{"b": 1}]], "t": "{{{"}, "n": '), F.col("id").cast("string"), F.lit("}"))
    got = json_files.flat_scalars(spark.range(2).select("id", F.parse_json(text).alias("v")), "id", "v")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("Generate") == 2
    assert sorted(tuple(r) for r in got.collect()) == [(i, n, v, d) for i in range(2) for n, v, d in (("a.t", "{{{", None), ("n", str(i), float(i)))]


def test_scalars_of_deep_objects_and_of_none(spark):
    deep = "".join('{"k": ' for _ in range(20)) + "1" + "}" * 20
    rows = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id long, j string").select("id", F.parse_json("j").alias("v"))
    assert [tuple(r) for r in json_files.flat_scalars(rows("2", deep, '{"k": {}}'), "id", "v").collect()] == [(1, ".".join("k" * 20), "1", 1.0)]
    assert json_files.flat_scalars(rows("3", "[{}]", None, "null"), "id", "v").collect() == []
    assert json_files.flat_scalars(rows("{}"), "id", "v").collect() == json_files.flat_scalars(rows('{"k": 1}', "2"), "id", "v", depth=0).collect() == []
