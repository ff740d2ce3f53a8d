"""Clean text from raw documents in four stages: toxic ones go, one of each near-duplicate class stays, passages that an
earlier document has go, and what is left is packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.llm import near, packing, substring, toxicity
from factlens.llm.common import written
from factlens.llm.tokens import vocabulary_path

TOXIC_FROM = 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under TOXIC_FROM. Rows without an id are scored too, by their text."""
    model = toxicity.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, model, carry=docs.columns, score_col="__score", spans_col="__spans")
    return scored.where(F.col("__score") < TOXIC_FROM).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of each class whose id is the class's; rows without an id stay. Rows that share that id stay with each text they have: once, with the smallest of their other columns."""
    keep = near.near_duplicate_classes(docs).where("doc_id = class_id").select(F.col("doc_id").alias("__keep")).distinct()
    kept = docs.join(keep, F.col("doc_id") == F.col("__keep"), "left_semi")
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*others or [F.lit(0)]))
    return kept.withColumn("__first", first).where("__first = 1").drop("__first").unionByName(docs.where("doc_id IS NULL"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated passages. A text that lost nothing is unchanged; one that lost every word is empty and stays."""
    done = substring.remove_repeats(docs, with_text=True, carry=tuple(c for c in docs.columns if c != "doc_id"))
    lost = F.col("n_removed") > 0
    new = {"text": F.when(lost, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.char_length("kept")).otherwise(F.col("n_chars"))
    return done.select(*[new.get(c, F.col(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_stage), ("substring_dedup", substring_stage), ("packing", packing_stage)]

#: The stages' models and alignments have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
