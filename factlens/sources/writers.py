"""Sinks: tables as JSON lines by relation, CSV, label files in numeric id order, and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric_id(column: str) -> Column:
    """Q12 and P12 sort as 12."""
    return F.substring(F.col(column), 2, 20).cast("bigint")


def json_by(df: DataFrame, path: str, key: str = "relation") -> None:
    df.repartition(key).write.partitionBy(key).mode("overwrite").json(path)


def label_file(labels: DataFrame, path: str) -> None:
    """entity, then "label"@lang chunks in language order; entities in numeric order."""
    chunk = F.concat(F.lit('"'), F.col("label"), F.lit('"@'), F.col("lang"))
    rows = labels.groupBy("entity").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lang", chunk.alias("c")))), lambda x: x["c"]), "\t").alias("t"))
    rows.orderBy(numeric_id("entity")).select(F.concat_ws("\t", "entity", "t").alias("value")).write.mode("overwrite").text(path)


def split_manifest(df: DataFrame) -> DataFrame:
    """One JSON document: each part's facts, sorted, and the counts by relation. A manifest is one document by its nature."""
    fact = F.array("relation", "sub_uri", "obj_uri")
    parts = [F.sort_array(F.collect_list(F.when(F.col("part") == p, fact))).alias(p) for p in ("train", "val", "test")]
    counts = df.groupBy("relation").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation", "n")))).alias("relation_counts"))
    return df.agg(*parts).crossJoin(counts).select(F.to_json(F.struct("relation_counts", "train", "val", "test")).alias("value"))  # one row each


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A result table (collected: it is meant to be read) with rounded numbers and empty cells for nulls."""
    rows = [["" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r] for r in df.collect()]
    return "\n".join(f"| {' | '.join(r)} |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV files with a header; mark: each begins with a byte-order mark, for spreadsheets."""
    first, *rest = df.columns
    df.toDF(("﻿" if mark else "") + first, *rest).write.mode("overwrite").csv(path, header=True)


def tail_file(df: DataFrame, path: str, key: str, value: str, sep: str = "\t") -> None:
    """A key, then its distinct values in order, a line each; keys in numeric order: aliases, genders, instances, categories."""
    rows = df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(value)), sep).alias("t"))
    rows.orderBy(numeric_id(key), key).select(F.concat_ws("\t", key, "t").alias("value")).write.mode("overwrite").text(path)


def objects_file(df: DataFrame, path: str, relation: str, sub: str, obj: str) -> None:
    """Subject, relation and its objects, parted by blanks; relations, then subjects, in numeric order."""
    rows = df.groupBy(relation, sub).agg(F.array_join(F.sort_array(F.collect_set(obj)), " ").alias("t"))
    rows.orderBy(numeric_id(relation), numeric_id(sub)).select(F.concat_ws("\t", sub, relation, "t").alias("value")).write.mode("overwrite").text(path)


def aligned_texts(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One text folder a column, whose lines answer each other: the rows are ranged once by order, written, and each column is taken from there."""
    from ..shared import written

    rows = written(df.select(*dict.fromkeys([*order, *columns])).orderBy(*order), "aligned")
    for c in columns:
        rows.orderBy(*order).select(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(f"{path}/{c}")


def tokenized_json(df: DataFrame, path: str, tokens: str) -> None:
    """JSON lines of each fact with its tokens and their number."""
    df.withColumn("n_tokens", F.size(tokens)).write.mode("overwrite").json(path)
