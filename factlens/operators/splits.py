"""Quotas, splits, samples and set operations over fact keys. Order is by a hash of seed and key, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .running import numbered_within, running


def shuffled(seed: int | str, *keys: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def largest_remainder(totals: DataFrame, key: str, count: str, budget: int) -> DataFrame:
    """Whole quotas in proportion to the counts that add up to budget; what is left over goes to the largest fractions, ties to
    the smaller key. The windows run over one row a group."""
    every = Window.partitionBy(F.lit(0))
    exact = F.lit(budget).cast("double") * F.col(count) / F.sum(count).over(every)
    x = totals.select(key, count, exact.alias("__e")).withColumn("__q", F.floor("__e").cast("long"))
    x = x.withColumn("__r", F.row_number().over(every.orderBy((F.col("__e") - F.col("__q")).desc(), key))).withColumn("__left", F.lit(budget) - F.sum("__q").over(every))
    return x.select(key, count, (F.col("__q") + F.when(F.col("__r") <= F.col("__left"), 1).otherwise(0)).alias("quota"))


def stratified_split(df: DataFrame, stratum: str, key: str, seed: int | str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """part: of each stratum's n rows in hashed order the first floor(n * train) train, the next floor(n * val) val, the rest test."""
    x = numbered_within(df.withColumn("__h", shuffled(seed, key)), [stratum], ["__h", key], "__r", "__n").drop("__h")
    a, b = F.floor(F.col("__n") * F.lit(float(train))), F.floor(F.col("__n") * F.lit(float(val)))
    return x.withColumn("part", F.when(F.col("__r") <= a, "train").when(F.col("__r") <= a + b, "val").otherwise("test")).drop("__n", "__r")


def random_split(df: DataFrame, key: str, seed: int | str, val: float, buckets: int = 1 << 16) -> DataFrame:
    """Unstratified: each row by its hash alone, so there is no shuffle and a row never changes sides when others come."""
    h = F.conv(F.substring(shuffled(seed, key), 1, 4), 16, 10).cast("int")
    return df.withColumn("part", F.when(h < F.lit(int(val * buckets)), "val").otherwise("train"))


def take_quota(df: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: int | str) -> DataFrame:
    """Each stratum's first rows in hashed order, up to its quota."""
    x = numbered_within(df.withColumn("__h", shuffled(seed, key)), [stratum], ["__h", key], "__r").drop("__h")
    return x.join(quotas.select(stratum, "quota"), stratum).where("__r <= quota").drop("__r", "quota")


def round_robin(df: DataFrame, stratum: str, key: str, seed: int | str, hands: list[str]) -> DataFrame:
    """Deals rows to hands with one counter that runs on over the strata. The counter is the stratum's offset (from one row a
    stratum) plus the place in it; a large stratum is numbered by many tasks."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    before = Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(stratum, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    x = numbered_within(df.withColumn("__h", shuffled(seed, key)), [stratum], ["__h", key], "__r").drop("__h").withColumn("__r", F.col("__r") - 1).join(sizes, stratum)
    return x.withColumn("hand", F.element_at(F.array(*[F.lit(h) for h in hands]), (F.pmod(F.col("__o") + F.col("__r"), F.lit(len(hands))) + 1).cast("int"))).drop("__r", "__o")


def balanced_batches(df: DataFrame, lang: str, key: str, seed: int | str, per_lang: int) -> DataFrame:
    """batch numbers with per_lang rows of every language; what does not fill a batch in each language is left out."""
    x = numbered_within(df.withColumn("__h", shuffled(seed, key)), [lang], ["__h", key], "__r").drop("__h")
    x = x.withColumn("batch", F.floor((F.col("__r") - 1) / per_lang).cast("int")).drop("__r")
    least = df.groupBy(lang).agg(F.floor(F.count("*") / per_lang).alias("__b")).agg(F.min("__b").alias("__b"))  # one row
    return x.crossJoin(F.broadcast(least)).where("batch < __b").drop("__b")


def sample_per_group(df: DataFrame, group: list[str], key: str, n: int, seed: int | str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(shuffled(seed, key), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def in_all(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Keys that every group has: one shuffle, whatever the number of groups."""
    n = df.select(group).distinct().agg(F.count("*").alias("__l"))
    return df.groupBy(*keys).agg(F.countDistinct(group).alias("__n")).crossJoin(F.broadcast(n)).where("__n = __l").select(*keys)  # n is one row


def shared_keys(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Keys in more than one part; a sound split has none."""
    return df.groupBy(*keys).agg(F.countDistinct(part).alias("n_parts")).where("n_parts > 1")


def weighted_sample(df: DataFrame, group: list[str], key: str, weight: str, n: int, seed: int | str) -> DataFrame:
    """n rows of each group without replacement, in proportion to weight: those with the smallest -ln(u) / weight, u from a hash."""
    u = (F.conv(F.substring(shuffled(seed, key), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    w = Window.partitionBy(*group).orderBy(-F.log(u) / F.col(weight), key)
    return df.where(F.col(weight) > 0).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def first_examples(df: DataFrame, keys: list[str], order: str, usable: Column, n: int) -> DataFrame:
    """The first n usable rows of each group by order: nth (from 1), and how many unusable rows came before."""
    x = df.withColumn("__u", usable.cast("int"))
    x = running(x, keys, [order], {"nth": F.col("__u"), "skipped": 1 - F.col("__u")}).withColumn("nth", F.col("nth").cast("int"))
    return x.where((F.col("__u") == 1) & (F.col("nth") <= n)).drop("__u")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """name: the row's place by order, from 0. A range exchange puts neighbours together, each range is counted, and the ranges' prefix sums (one row a range) are added; no task sees all rows. The ranges are written once, for they are drawn anew each time they are computed."""
    x = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    x = x.withColumn("__place", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    ends = x.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.join(F.broadcast(ends.select("__range", before.alias("__before"))), "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")


def every_n(df: DataFrame, order: list[str], n: int, name: str = "batch") -> DataFrame:
    """name: which n rows in a row, by order, a row belongs to, from 0."""
    return numbered(df, order, name).withColumn(name, F.expr(f"`{name}` div {n}"))


def balanced_negatives(df: DataFrame, keys: list[str], positive: str, order: str) -> DataFrame:
    """All positives of each group and as many of its negatives, the first by order."""
    group = Window.partitionBy(*keys)
    x = df.withColumn("__n", F.count_if(positive).over(group)).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, positive).orderBy(order)))
    return x.where(F.col(positive) | (F.col("__r") <= F.col("__n"))).drop("__n", "__r")
