"""Readers for the text formats of facts, labels, templates, manifests and predictions. Schemas are declared, so nothing is
inferred; malformed input is counted or raises as each reader says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import last_split, strip_quotes
from ..shared import written

FACT = "uuid string, predicate_id string, sub_uri string, obj_uri string, sub_label string, obj_label string, count long"
PREDICTION = "relation string, sub_uri string, obj_uri string, labels array<string>, prompt string, num_mask int, sentence array<string>, tokenized_obj_label array<string>, pred array<array<string>>, pred_log_prob array<array<double>>"
SPLIT = "metadata map<string,string>, relation_counts map<string,string>, train array<array<string>>, val array<array<string>>, test array<array<string>>"
BUDGET = "metadata map<string,string>, train map<string,array<array<string>>>"


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def facts(spark: SparkSession, path: str, strict: bool = True, relations: list[str] | None = None) -> DataFrame:
    """JSON lines, a file a relation; relation is the file's stem. strict: invalid JSON or a missing key raises."""
    lines = spark.read.text(path).select("value", _stem(F.col("_metadata.file_path")).alias("relation")).where(F.length(F.trim("value")) > 0)
    if relations is not None:
        lines = lines.where(F.col("relation").isin(relations))
    row = F.from_json("value", FACT)
    if strict:
        keys = F.json_object_keys("value")
        bad = keys.isNull() | (F.size(F.array_except(F.array(*[F.lit(k) for k in ("sub_uri", "obj_uri", "predicate_id")]), keys)) > 0)
        row = F.when(bad, F.raise_error(F.concat(F.lit("invalid fact: "), F.col("value"))).cast(row_type())).otherwise(row)
    return lines.select("relation", row.alias("f")).select("relation", "f.*")


def row_type() -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in (x.strip().split(" ") for x in FACT.split(","))) + ">"


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated: an entity, then "label"@lang chunks, cut at the last @. entity, lang, label, malformed: the later entry of
    a language wins; a chunk without @ has a null language and is marked malformed."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    x = lines.select(F.split("value", "\t").alias("p"))
    x = x.select(F.element_at("p", 1).alias("entity"), F.posexplode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("pos", "chunk"))
    text, lang = last_split("chunk", "@")
    x = x.select("entity", "pos", lang.alias("lang"), strip_quotes(text).alias("label"))
    return x.groupBy("entity", "lang").agg(F.max_by("label", "pos").alias("label")).withColumn("malformed", F.col("lang").isNull())


def _fields(spark: SparkSession, path: str, n: int) -> DataFrame:
    """p: the n tab-separated fields of each line that is not blank, quotes as they stand; any other number of fields raises. at: the line's place, by file and in it."""
    p = F.split("value", "\t", -1)
    wrong = F.raise_error(F.concat(F.lit(f"not {n} fields: "), F.col("value")))
    x = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return x.select(F.when(F.size(p) == n, p).otherwise(wrong).alias("p"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("at"))


def genders(spark: SparkSession, path: str) -> DataFrame:
    """entity, gender (male, female or none) of lines of exactly two fields."""
    v = F.lower(F.trim(F.col("p")[1]))
    return _fields(spark, path, 2).select(F.col("p")[0].alias("entity"), F.when(v.isin("male", "female"), v).otherwise("none").alias("gender"))


def tail_columns(spark: SparkSession, path: str, name: str, sep: str = ",") -> DataFrame:
    """entity and all further columns of its line, joined (instance lists) or as an array (sep None)."""
    p = F.split("value", "\t")
    tail = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.element_at(p, 1).alias("entity"), (F.array_join(tail, sep) if sep is not None else tail).alias(name))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """lang (the file's stem), entity, alias; a repeated entity adds to its aliases."""
    x = spark.read.text(path).select(F.split("value", "\t").alias("p"), _stem(F.col("_metadata.file_path")).alias("lang"))
    return x.select("lang", F.element_at("p", 1).alias("entity"), F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("alias"))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """sub, relation and the array of objects (blank-separated); the last line of a subject and relation wins."""
    p = F.col("p")
    x = _fields(spark, path, 3).select(p[0].alias("sub"), p[1].alias("relation"), F.split(p[2], " ").alias("objs"), "at")
    last = F.row_number().over(Window.partitionBy("sub", "relation").orderBy(F.col("at").desc()))
    return x.withColumn("nth", last).where("nth = 1").select("sub", "relation", "objs")


def templates(spark: SparkSession, path: str, langs: list[str], key: str = "pid") -> DataFrame:
    """pid, lang, template of a wide CSV; a missing language column raises, an empty cell is left out."""
    wide = spark.read.csv(path, header=True, quote='"', escape='"')
    if missing := [x for x in langs if x not in wide.columns]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return wide.unpivot([key], langs, "lang", "template").where(F.length(F.trim("template")) > 0)


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, relation, sub_uri, obj_uri; a fact in two parts raises when it is read."""
    doc = spark.read.schema(SPLIT).option("multiLine", True).json(path)
    parts = [doc.select(F.lit(p).alias("part"), F.explode(p).alias("f")) for p in ("train", "val", "test")]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("part", F.col("f")[0].alias("relation"), F.col("f")[1].alias("sub_uri"), F.col("f")[2].alias("obj_uri"))
    per = x.groupBy("relation", "sub_uri", "obj_uri").agg(F.collect_set("part").alias("p"))
    one = F.when(F.size("p") > 1, F.raise_error(F.concat(F.lit("in two parts: "), F.concat_ws(" ", "relation", "sub_uri", "obj_uri")))).otherwise(F.element_at("p", 1))
    return per.select(one.alias("part"), "relation", "sub_uri", "obj_uri")


def budget_manifest(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(BUDGET).option("multiLine", True).json(path)
    x = doc.select(F.explode("train").alias("lang", "facts")).select("lang", F.explode("facts").alias("f"))
    return x.select("lang", F.col("f")[0].alias("relation"), F.col("f")[1].alias("sub_uri"), F.col("f")[2].alias("obj_uri"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Nested predictions; file_relation is the file's stem."""
    return spark.read.schema(PREDICTION).json(path).withColumn("file_relation", _stem(F.col("_metadata.file_path")))


def runs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON documents under <model>/<run>/seed<n>/, with the three from the path."""
    p = F.col("_metadata.file_path")
    x = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return x.select("*", *[F.regexp_extract(p, r"([^/]+)/([^/]+)/seed(\d+)/[^/]+$", i).alias(n) for i, n in ((1, "model"), (2, "run"))], F.regexp_extract(p, r"seed(\d+)/[^/]+$", 1).cast("int").alias("seed"))


def csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; a missing path gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).csv(path, header=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_id (from 0 in its file), value of every line; a file without bytes has none. Lines end in \\n, \\r\\n or \\r.

    A large file is read by as many tasks as it has byte ranges. Each range counts its lines, the counts before it in its file
    give its first number, and a line's place in its range the rest, so only one row a range is shuffled. The lines are
    written once: another scan may cut the files elsewhere, as the cut depends on the executors at hand.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start")]
    x = written(spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("__at"), "value"), "lines")
    ranges = x.groupBy("file", "__start").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "__start", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return x.join(ranges, ["file", "__start"]).select("file", (F.col("__at") + F.col("__shift")).alias("line_id"), "value")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """entity, is_category: tab-separated, any whole number but 0 is true."""
    p = F.split("value", "\t")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.get(p, F.lit(0)).alias("entity"), (F.trim(F.get(p, F.lit(1))).cast("int") != 0).alias("is_category"))


def relations(spark: SparkSession, path: str) -> DataFrame:
    """Relation metadata, JSON lines; of lines that share a relation one stays, the last by file and place in it."""
    x = spark.read.schema("relation string, template string, label string, description string, type string").json(path)
    x = x.withColumn("__at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    rest = [c for c in x.columns if c != "relation"]
    return x.groupBy("relation").agg(*[F.max(F.struct("__at", *[c for c in rest if c != "__at"])).alias("r")]).select("relation", *[F.col(f"r.{c}").alias(c) for c in rest if c != "__at"])


def languages_of(spark: SparkSession, path: str, keys: tuple[str, ...] = ("pid", "relation")) -> list[str]:
    """The languages that a template file has columns for: its header without the keys."""
    return [c for c in spark.read.csv(path, header=True).columns if c not in keys]


def template_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated templates with a header: relation, label, description, type, template by place; missing columns are null."""
    return spark.read.schema("relation string, label string, description string, type string, template string").csv(path, sep="\t", header=True, enforceSchema=True, quote="")


def extra_prompts(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """relation (the file's stem), nth (from 0), template: the first `most` lines of each file. The cut is the feature."""
    x = lines(spark, path).where(F.length(F.trim("value")) > 0)
    return x.where(F.col("line_id") < most).select(_stem(F.col("file")).alias("relation"), F.col("line_id").alias("nth"), F.get_json_object("value", "$.template").alias("template"))


def restricted_facts(spark: SparkSession, path: str, part: str) -> DataFrame:
    """relation (null in pairs), sub_uri, obj_uri of one part of a manifest; entries of other than two or three raise."""
    x = spark.read.schema(f"`{part}` array<array<string>>").option("multiLine", True).json(path).select(F.explode(f"`{part}`").alias("f"))
    n = F.size("f")
    f = F.when(n.isin(2, 3), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("a restricted fact needs two or three entries: "), F.array_join("f", ","))).cast("array<string>"))
    return x.select(F.when(n == 3, F.get(f, F.lit(0))).alias("relation"), F.element_at(f, -2).alias("sub_uri"), F.element_at(f, -1).alias("obj_uri")).distinct()


def histories(spark: SparkSession, pattern: str) -> DataFrame:
    """model, run, seed, epoch, lang, val_loss, train_loss (null for languages without): one row an epoch and validated language."""
    x = runs(spark, pattern, "epoch int, val_loss_by_lang map<string,double>, train_loss_by_lang map<string,double>")
    x = x.select("model", "run", "seed", "epoch", "train_loss_by_lang", F.explode("val_loss_by_lang").alias("lang", "val_loss"))
    return x.withColumn("train_loss", F.try_element_at("train_loss_by_lang", "lang")).drop("train_loss_by_lang")


def prediction_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose header may repeat a name: the second of a name gets .1, and so on, as pandas names them; all columns are strings."""
    head = spark.read.text(path).first()
    seen: dict[str, int] = {}
    names = []
    for c in (head.value if head else "").split(","):
        names.append(f"{c}.{seen[c]}" if c in seen else c)
        seen[c] = seen.get(c, 0) + 1
    schema = ", ".join(f"`{c}` string" for c in names)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation CSVs with a header, with or without a byte-order mark; source_file is the file's name. Columns are strings."""
    x = spark.read.csv(path, header=True)
    return x.toDF(*[c.lstrip("﻿") for c in x.columns]).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def code_switched(spark: SparkSession, path: str) -> DataFrame:
    """text, mentions (arrays of what stands between |||): tab-separated lines, the text first."""
    p = F.split(F.btrim("value", F.lit(" \t\r")), "\t")
    return spark.read.text(path).select(F.get(p, F.lit(0)).alias("text"), F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda m: F.split(m, r" \|\|\| ")).alias("mentions"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """Documents' triples: docid, predicate, sub_uri, sub_form, obj_uri, obj_form; only those of entities (Q) and properties (P)."""
    end = "struct<uri:string,surfaceform:string>"
    x = spark.read.schema(f"docid string, triples array<struct<subject:{end},predicate:{end},object:{end}>>").option("multiLine", True).json(path)
    tail = lambda c: F.element_at(F.split(F.col(c), "[/#]"), -1)
    x = x.select("docid", F.explode("triples").alias("t")).select(
        "docid", tail("t.predicate.uri").alias("predicate"), tail("t.subject.uri").alias("sub_uri"), F.col("t.subject.surfaceform").alias("sub_form"), tail("t.object.uri").alias("obj_uri"), F.col("t.object.surfaceform").alias("obj_form")
    )
    return x.where("predicate LIKE 'P%' AND sub_uri LIKE 'Q%' AND obj_uri LIKE 'Q%'")
