"""Which facts are in which lists: splits, flagged facts, expected facts, and what is missing. Lists are tables, joined by
their keys; a key that a list repeats counts once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(df: DataFrame, keys: list[str], members: DataFrame) -> DataFrame:
    """Rows whose key is in members."""
    return df.join(members.select(*keys), keys, "left_semi")


def unlisted(df: DataFrame, keys: list[str], members: DataFrame) -> DataFrame:
    """Rows whose key is not in members: flagged facts taken out, expected facts not found, ids to ask for again."""
    return df.join(members.select(*keys), keys, "left_anti")


def first_listed(df: DataFrame, keys: list[str], members: DataFrame, order: str) -> DataFrame:
    """Of the rows of each key in members, the first by order (an aggregate: it combines map-side)."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    got = listed(df, keys, members).groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__f"))
    return got.select(*keys, F.col(f"__f.{order}").alias(order), *[F.col(f"__f.{c}").alias(c) for c in rest])


def with_part(df: DataFrame, keys: list[str], manifest: DataFrame, parts: list[str], part: str = "part") -> DataFrame:
    """part: the first of parts that lists the row's key; null if none does."""
    at = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col(part))
    first = manifest.groupBy(*keys).agg(F.min(F.when(at > 0, at)).alias("__p"))
    return df.join(first, keys, "left").withColumn(part, F.when(F.col("__p").isNotNull(), F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("__p").cast("int")))).drop("__p")


def known_endpoints(facts: DataFrame, sub: str, obj: str, entities: DataFrame, entity: str) -> DataFrame:
    """Facts whose subject and object both are entities of the list."""
    known = entities.select(F.col(entity).alias("__e"))
    return facts.join(known, F.col(sub) == F.col("__e"), "left_semi").join(known, F.col(obj) == F.col("__e"), "left_semi")


def missing_combinations(df: DataFrame, left: str, right: str, rights: DataFrame) -> DataFrame:
    """(left, right) of every left value in df and right value in rights that df lacks. The grid is exploded in place: one row a left value and, in it, the distinct right values (relations, of which there are few)."""
    every = rights.agg(F.collect_set(right).alias("__all"))  # one row
    have = df.groupBy(left).agg(F.collect_set(right).alias("__have"))
    return have.join(F.broadcast(every)).select(left, F.explode(F.array_except("__all", "__have")).alias(right))


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def concat(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with unlike columns; a column that a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def partition_check(whole: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row: keys of the whole that no part has, keys of a part that the whole lacks, and keys in several parts. All 0 for a partition."""
    x = whole.select(*keys).distinct().withColumn("__w", F.lit(1)).withColumn("__p", F.lit(0))
    for p in parts.values():
        x = x.unionByName(p.select(*keys).distinct().withColumn("__w", F.lit(0)).withColumn("__p", F.lit(1)))
    got = x.groupBy(*keys).agg(F.sum("__w").alias("w"), F.sum("__p").alias("p"))
    return got.agg(F.count(F.when(F.col("p") == 0, 1)).alias("missing"), F.count(F.when(F.col("w") == 0, 1)).alias("extra"), F.count(F.when(F.col("p") > 1, 1)).alias("shared"))


def entities_of(df: DataFrame, columns: list[str], name: str = "entity") -> DataFrame:
    """Distinct non-null values of several id columns, in one pass."""
    return df.select(F.explode(F.array(*columns)).alias(name)).where(F.col(name).isNotNull()).distinct()


def counts_of(groups: DataFrame, key: str, rows: DataFrame, name: str = "n") -> DataFrame:
    """How many rows each group has; 0 where it has none."""
    return groups.select(key).distinct().join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").na.fill(0, [name])


def frequent(df: DataFrame, keys: list[str], least: int, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) >= least)


def counts_with_total(df: DataFrame, by: str, key: str, total: str = "all") -> DataFrame:
    """Counts by (by, key) and, with total in by's place, by key."""
    got = df.groupBy(by, key).agg(F.count("*").alias("n"))
    return got.unionByName(got.groupBy(key).agg(F.sum("n").alias("n")).withColumn(by, F.lit(total)))


def objects_of(facts: DataFrame, more: DataFrame, sub: str, relation: str, obj: str) -> DataFrame:
    """The sorted distinct objects of each (subject, relation): those listed, and the facts' own."""
    both = facts.select(sub, relation, obj).unionByName(more.join(facts.select(sub, relation).distinct(), [sub, relation], "left_semi").select(sub, relation, obj))
    return both.groupBy(sub, relation).agg(F.sort_array(F.collect_set(obj)).alias("objects"))


def preferred(value: str, order: list[str]) -> list[Column]:
    """Sort keys: the values of order in that order, then the others alphabetically."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(value))
    return [F.when(at > 0, at).otherwise(len(order) + 1).cast("int"), F.col(value)]
