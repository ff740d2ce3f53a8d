"""What the queries share: a registry, and the driver tables in the roles of the package's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str) -> Column:
    return F.size(F.split(F.col(text), " ")).cast("long")


#: Predictions: one row a (language, relation, fact, seed), correct or not by two systems, and the gold answer's length.
PRED_SQL = """pred AS (
  SELECT d.doc_id AS fact, d.lang AS lang, d.source AS relation, l.quality AS correct, l.toxic AS other, d.doc_id % 3 AS seed,
         CAST(len(string_split(d.text, ' ')) AS BIGINT) AS gold_len
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = d.select(F.col("doc_id").alias("fact"), "lang", F.col("source").alias("relation"), (F.col("doc_id") % 3).alias("seed"), n_words("text").alias("gold_len"))
    return d.join(labels.select(F.col("doc_id").alias("fact"), F.col("quality").alias("correct"), F.col("toxic").alias("other")), "fact")


#: A fact scored for several languages: an order line by return flag as language, its order as fact.
LANGS_SQL = """facts AS (
  SELECT l_orderkey AS fact, l_returnflag || l_linestatus AS lang, CAST(max(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS INTEGER) AS correct,
         l_orderkey % 3 AS seed, 'R' || (l_orderkey % 7) AS relation
  FROM lineitem GROUP BY ALL)"""


def language_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount")
    return x.groupBy(F.col("l_orderkey").alias("fact"), F.concat("l_returnflag", "l_linestatus").alias("lang")).agg(F.max(F.when(F.col("l_discount") >= 0.05, 1).otherwise(0)).alias("correct")).withColumn("seed", F.col("fact") % 3).withColumn("relation", F.concat(F.lit("R"), (F.col("fact") % 7).cast("string")))


def r6(c: Column) -> Column:
    return F.round(c, 6)
