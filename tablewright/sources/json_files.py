"""JSON sources and sinks with explicit schemas; the place of a record is data."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.items import explanation_lists

OPTION = "struct<option_id:string,text:string>"
EXAMPLE = f"example_id string, query string, options array<{OPTION}>, answer_option_id string, query_type_flags struct<Specific:boolean,Commonsense:boolean,Negated:boolean,Analogical:boolean,Temporal:boolean>, correctness_explanation variant, source_metadata variant"
PREDICTION = "run_id string, phase string, provider string, model_name string, split string, example_id string, prompt_version string, raw_response string, parsed_choice string, predicted_option_id string, gold_option_id string, is_correct boolean, latency_ms double, metadata variant"
RESULT = "model string, split string, eval_mode string, metrics variant, results array<struct<index:int,example_id:string,query:string,correct_answer_id:string,correct_letter:string,predicted_letter:string,predicted_id:string,is_correct:boolean,parse_failure:boolean,raw_response:string>>"
REGISTRY = "entry_id string, run_id string, run_type string, stage string, status string, model_name string, created_at string, updated_at string, parent_run_id string, artifact_path string, metrics variant, metadata variant"
FLAGS = "struct<Specific:boolean,Commonsense:boolean,Negated:boolean,Analogical:boolean,Temporal:boolean>"
_SYNTHETIC = f"pos long, example_id string, query string, options array<{OPTION}>, answer_option_id string, query_type_flags {FLAGS}, synthetic_mode string, generator_model string, generation_prompt_version string, approval_batch_id string, review_status string, review_scores map<string,double>, created_at string, intended_query_type_target string, generation_notes string, review_summary string, reviewer_model string, reviewed_at string, review_prompt_version string"
SYNTHETIC_QUERY = f"{_SYNTHETIC}, parent_example_id string, generation_method string"
SYNTHETIC_FULL = f"{_SYNTHETIC}, seed_example_ids array<string>, correctness_explanation map<string,array<string>>, distractor_generation_method string, distribution_fit_score double"
_MADE = f"{_SYNTHETIC}, seed_example_ids array<string>, distractor_generation_method string, distribution_fit_score double".split("query_type_flags " + FLAGS + ", ")[1]
#: Full synthetic records as two nested objects: the item, and where it is from.
NESTED_FULL = f"recipe_example struct<{EXAMPLE}>, provenance struct<{_MADE}>"
RAW = "array<struct<query:string,query_type:map<string,variant>,options:map<string,string>,answer:string,correctness_explanation:map<string,variant>>>"
#: Fields that a prediction must have; the others may be missing.
NEEDED = ("run_id", "phase", "provider", "model_name", "split", "example_id", "prompt_version", "raw_response", "gold_option_id", "is_correct")


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """Files that are one JSON array of objects each: (file, pos, record), the text of each object and its place in its file.

    A file is read by byte ranges, as pieces that end at a closing brace. Whether a piece starts within a string, and how
    deep in objects, are sums over the pieces before it: quotes (escaped ones apart) and braces. They are summed within
    each range, then over the ranges' totals, so a file is never in one task. Only pieces of one object meet again.
    An array that is broken off, or holds anything but objects, fails the read; an empty file has no records.
    """
    # an escape never spans pieces: a brace is not escaped in JSON. lineSep is the brace, so pieces come without it
    pieces = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    parts = F.split(F.regexp_replace("value", r"\\.", "__"), '"')
    opened = lambda of: F.length(of) - F.length(F.replace(of, F.lit("{"), F.lit("")))
    inside = lambda odd: F.aggregate(F.transform(parts, lambda p, i: F.when(i % 2 == odd, opened(p)).otherwise(0)), F.lit(0), lambda a, x: a + x)
    pieces = pieces.withColumn("quotes", F.size(parts) - 1)
    # of a piece: the change of depth if it starts outside of a string, and if it starts inside one; its own brace counts where it ends outside
    pieces = pieces.withColumn("d0", inside(0) - F.when(F.col("quotes") % 2 == 0, 1).otherwise(0)).withColumn("d1", inside(1) - F.when(F.col("quotes") % 2 == 1, 1).otherwise(0))

    def running(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        """Quotes and changes of depth before each row, for both states at the start of the window."""
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("q", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
        here = lambda start: F.when((F.col("q") + start) % 2 == 0, F.col("d0")).otherwise(F.col("d1"))
        rows = rows.withColumn("own0", here(0)).withColumn("own1", here(1))
        return rows.withColumn("b0", F.coalesce(F.sum("own0").over(before), F.lit(0))).withColumn("b1", F.coalesce(F.sum("own1").over(before), F.lit(0)))

    local = running(pieces, ["file", "block"], "n")
    totals = local.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("own0").alias("d0"), F.sum("own1").alias("d1"))
    totals = running(totals, ["file"], "block")  # a row of numbers a range
    every = Window.partitionBy("file")
    # the last piece is the end of the array, and has no brace: it brings the depth to -1
    broken = (F.sum("own0").over(every) != -1) | (F.sum("quotes").over(every) % 2 != 0)
    totals = totals.select("file", "block", (F.col("q") % 2).alias("start"), F.col("b0").alias("deep"), broken.alias("broken"))
    known = local.join(totals, ["file", "block"])
    out = (F.col("q") + F.col("start") + F.col("quotes")) % 2 == 0
    first = F.col("start") == 0
    deep = F.col("deep") + F.when(first, F.col("b0") + F.col("own0")).otherwise(F.col("b1") + F.col("own1"))
    known = known.select("file", "block", "n", "value", "broken", (out & (deep == 0)).alias("last"), (out & (deep < 0)).alias("tail"))
    # records that end before a piece: within its range, then in the ranges before
    seen = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("done", F.coalesce(F.sum(F.col("last").cast("long")).over(seen), F.lit(0)))
    ends = known.groupBy("file", "block").agg(F.sum(F.col("last").cast("long")).alias("ends"))
    ends = ends.select("file", "block", F.coalesce(F.sum("ends").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = known.join(ends, ["file", "block"]).withColumn("pos", F.col("base") + F.col("done"))
    records = placed.groupBy("file", "pos").agg(
        F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("p"), F.max("broken").alias("broken"), F.max("tail").alias("tail"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), "}")
    lead = F.when(F.col("pos") == 0, r"^\s*\[\s*").otherwise(r"^\s*,\s*")
    fine = F.when(F.col("tail"), text.rlike(r"^\s*\]\s*$") | ((F.col("pos") == 0) & text.rlike(r"^\s*\[\s*\]\s*$"))).otherwise(F.regexp_like(text, F.concat(lead, F.lit(r"\{"))))
    checked = records.withColumn("fine", fine & ~F.col("broken")).withColumn("text", F.concat(F.regexp_replace(text, lead, F.lit("")), F.lit("}")))
    # the end of the array is checked with the records, as a row that is then left out
    checked = checked.withColumn("record", F.when(F.col("fine"), F.when(~F.col("tail"), F.col("text"))).otherwise(F.raise_error(F.concat(F.lit("not an array of objects: "), F.col("file")))))
    return checked.where(F.col("record").isNotNull()).select("file", "pos", "record")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array of records: (pos, query, query_type, options, answer, correctness_explanation)."""
    record = F.from_json("record", RAW.removeprefix("array<").removesuffix(">"), {"mode": "FAILFAST"})
    return read_array(spark, path).select("pos", record.alias("r")).select("pos", "r.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; blank lines are skipped, a bad record fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_full(spark: SparkSession, path: str) -> DataFrame:
    """Full synthetic rows as JSON lines, flat (SYNTHETIC_FULL) or nested (NESTED_FULL); rows without a place get one in the order of the file."""
    flat = SYNTHETIC_FULL.replace("correctness_explanation map<string,array<string>>", "correctness_explanation map<string,variant>")
    rows = spark.read.schema(f"{flat}, source_metadata variant, {NESTED_FULL.replace('correctness_explanation variant', 'correctness_explanation map<string,variant>')}").json(path, mode="FAILFAST")
    nested = {n: F.col(p)[n] for p in ("recipe_example", "provenance") for n in rows.schema[p].dataType.names}
    named = {c: F.coalesce(F.col(c), nested[c]) if c in nested else F.col(c) for c in rows.columns if c not in ("recipe_example", "provenance")}
    named["pos"] = F.coalesce("pos", F.monotonically_increasing_id())
    named["correctness_explanation"] = explanation_lists(named["correctness_explanation"])
    return rows.select(*[c.alias(n) for n, c in named.items()])


def write_nested_full(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Full synthetic rows as nested records, one JSON object a line; an item's metadata is kept."""
    made = [c for c in rows.columns if c in {f.split()[0] for f in _MADE.split(", ")}]
    empty = F.parse_json(F.lit("{}"))
    metadata = F.coalesce("source_metadata", empty) if "source_metadata" in rows.columns else empty
    item = F.struct("example_id", "query", "options", "answer_option_id", "query_type_flags", "correctness_explanation", metadata.alias("source_metadata"))
    ordered = rows.orderBy(*order) if order else rows
    write_lines(ordered.select(item.alias("recipe_example"), F.struct(*made).alias("provenance")), path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A split manifest, one JSON object: (split, pos, example_id)."""
    text = spark.read.text(path, wholetext=True)
    splits = text.select(F.explode(F.from_json("value", "splits map<string,array<string>>")["splits"]).alias("split", "ids"))
    return splits.select("split", F.posexplode("ids").alias("pos", "example_id"))


def manifest_violation(manifest: DataFrame) -> DataFrame:
    """Unknown splits and ids in two places."""
    named = manifest.where(~F.col("split").isin("train", "validation", "test")).select(F.lit("unknown split").alias("violation"), F.col("split").alias("value"))
    return named.union(manifest.groupBy("example_id").count().where("count > 1").select(F.lit("id in two places"), "example_id"))


def _refuse(name: str, bad: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(f"{name} is missing")))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records as JSON lines: missing optional fields are null, missing metadata is empty, other missing fields fail the read."""
    rows = spark.read.schema(PREDICTION).json(path, mode="FAILFAST")
    for name in NEEDED:
        kind = rows.schema[name].dataType
        rows = rows.withColumn(name, F.coalesce(name, _refuse(name, F.lit(True)).cast(kind)))
    return rows.withColumn("metadata", F.coalesce("metadata", F.parse_json(F.lit("{}"))))


def write_predictions(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    write_lines(rows.select(*[f.split()[0] for f in PREDICTION.split(", ")]), path, order)


def write_document(document: DataFrame, path: str) -> None:
    """A frame of one row as one JSON document, readable text; null fields are kept."""
    document.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"})).coalesce(1).write.mode("overwrite").text(path)


def write_listed(head: DataFrame, name: str, rows: DataFrame, order: str, path: str) -> None:
    """One JSON document: the fields of ``head`` (one row), and all rows in ``order`` (unique) as a list.

    Tasks write the list in ordered parts; the driver only copies their bytes, a buffer at a time, so no task and no
    process holds the list. The parts stand in a folder beside ``path`` until they are copied; a document that is
    broken off is not seen under its name. Null fields of a row are left out.
    """
    spark, parts, part = rows.sparkSession, f"{path}.parts", f"{path}.part"
    line = F.to_json(F.struct(*rows.columns))
    first = rows.orderBy(order).limit(1).select(order, line.alias("line")).first()
    opening = head.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0][:-1]
    if first is not None:
        rest = rows.where(F.col(order) > F.lit(first[order])).orderBy(order)
        rest.select(F.concat(F.lit(","), line)).write.mode("overwrite").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(conf)
    out = files.create(at(part), True)

    def put(text: str) -> None:
        out.write(bytearray(text.encode()))

    put(f"{opening}{',' if len(opening) > 1 else ''}{json.dumps(name)}: [\n")
    if first is not None:
        put(first["line"] + "\n")
        for found in sorted(str(f.getPath()) for f in files.listStatus(at(parts)) if f.getPath().getName().startswith("part-")):
            source = files.open(at(found))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
    put("]}\n")
    out.close()
    files.delete(at(path), True)
    files.rename(at(part), at(path))
    files.delete(at(parts), True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths (or patterns) that lead to something, in order."""
    places = [(p, spark._jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return [p for p, at in places if len(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [])]


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Evaluation results, one JSON document a file: a missing mode is generative, missing figures fail the read.

    Of several paths those that are not there are skipped.
    """
    found = existing(spark, [path] if isinstance(path, str) else path)
    rows = spark.read.schema(RESULT).json(found, multiLine=True) if found else spark.createDataFrame([], RESULT)
    has = lambda name: F.try_variant_get("metrics", f"$.{name}", "double").isNotNull()
    lost = F.coalesce(*[_refuse(n, ~has(n)) for n in ("overall", "total_correct", "total")], *[_refuse(n, F.col(n).isNull()) for n in ("model", "split")])
    rows = rows.withColumn("eval_mode", F.coalesce(lost.cast("string"), "eval_mode", F.lit("generative")))
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1) if found else F.lit(None).cast("string"))


def read_config(path: str) -> dict:
    """Settings from one JSON object; a file that is not there is empty."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry; an absent file is an empty one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], REGISTRY)
    return read_lines(spark, path, REGISTRY)


def write_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines with null fields kept; files follow ``order`` by name."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size_bytes) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def _nesting(df: DataFrame, variant: str, most: int = 8) -> int:
    """Levels of objects in a variant column, those in lists apart: members are opened ``most`` levels deep, twice as many as long as that is not enough."""
    while True:
        rows = df.select(F.lit(0).alias("level"), F.col(variant).alias("v"))
        for _ in range(most):
            rows = rows.select("level", F.try_variant_get("v", "$", "map<string,variant>").alias("inner"))
            rows = rows.select((F.col("level") + F.col("inner").isNotNull().cast("int")).alias("level"), F.explode_outer(F.map_values("inner")).alias("v"))
        found = rows.agg(F.max("level")).first()[0] or 0  # one number
        if found < most:
            return found
        most *= 2


def flat_scalars(df: DataFrame, key: str, variant: str, depth: int | None = None) -> DataFrame:
    """(key, name, value, number): the scalars of a variant object at any depth, under dotted names.

    value is the scalar as text (booleans are true and false); number is that of numbers and booleans (1 and 0), else
    null. Lists, nulls and empty objects have no row; nor have variants that are null or no objects. ``depth`` is the
    number of levels to open; without it a job finds the greatest of all rows. Every level is opened in the same
    stage, so nothing is shuffled.
    """
    if depth is None:
        depth = _nesting(df, variant)
    # an object's own value is not carried on to its members, nor is the variant itself a scalar of an object
    rows = (df if depth else df.limit(0)).select(F.col(key).alias("key"), F.lit("").alias("name"), F.col(variant).alias("v"))
    for level in range(depth):
        rows = rows.withColumn("inner", F.try_variant_get("v", "$", "map<string,variant>"))
        scalar = F.when(F.col("inner").isNull(), F.col("v")) if level else F.lit(None).cast("variant")
        # outer: rows without members stay, and no filter is derived that would read the variant a second time
        opened = rows.select("key", "name", scalar.alias("v"), "inner").select("key", "name", "v", F.explode_outer("inner").alias("member", "value"))
        name = F.when(F.col("member").isNull(), F.col("name")).otherwise(F.concat("name", F.lit("."), "member")) if level else F.col("member")
        rows = opened.select("key", name.alias("name"), F.coalesce("value", "v").alias("v"))
    kind = F.schema_of_variant("v")
    rows = rows.where((kind != "VOID") & ~kind.endswith(">"))  # neither null, nor OBJECT<...> or ARRAY<...>
    number = F.when(kind == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("double")).when(kind != "STRING", F.try_variant_get("v", "$", "double"))
    return rows.select(F.col("key").alias(key), "name", F.try_variant_get("v", "$", "string").alias("value"), number.alias("number"))
