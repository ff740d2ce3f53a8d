"""Runs against runs: paired comparisons, sweeps over seeds and languages, drops and gains. Two-level means are two
aggregations; pairs come from an array of a fact's runs, so no table is joined to itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_pairs(df: DataFrame, keys: list[str], run: str, value: str) -> DataFrame:
    """keys, run_a < run_b, value_a, value_b of all pairs of runs that have the same key."""
    per = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(run).alias("r"), F.col(value).alias("v")))).alias("__x"))
    one = per.select(*keys, F.posexplode("__x").alias("__i", "p"), "__x")
    two = one.select(*keys, "p", F.explode(F.slice("__x", F.col("__i") + 2, F.size("__x"))).alias("q"))
    return two.select(*keys, F.col("p.r").alias("run_a"), F.col("q.r").alias("run_b"), F.col("p.v").alias("value_a"), F.col("q.v").alias("value_b")).where("run_a < run_b")


def paired_comparison(df: DataFrame, run: str, relation: str, fact: str, correct: str = "correct") -> DataFrame:
    """Of the facts that both runs have, macro accuracy (mean over relations of means over facts of means over seeds) and the difference b - a."""
    mean = df.groupBy(relation, fact, run).agg(F.avg(correct).alias("__c"))
    per = run_pairs(mean, [relation, fact], run, "__c").groupBy("run_a", "run_b", relation).agg(F.avg("value_a").alias("a"), F.avg("value_b").alias("b"), F.count("*").alias("n"))
    return per.groupBy("run_a", "run_b").agg(F.avg("a").alias("macro_a"), F.avg("b").alias("macro_b"), F.avg(F.col("b") - F.col("a")).alias("difference"), F.sum("n").alias("n"))


def ablation_means(df: DataFrame, keys: list[str], values: list[str], lang: str, run: str) -> DataFrame:
    """Means that ignore nulls, the distinct languages in order as one text, and how many runs."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.array_join(F.sort_array(F.collect_set(lang)), ",").alias("languages"), F.countDistinct(run).alias("n_runs"))


def value_stats(df: DataFrame, keys: list[str], value: str, seed: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.countDistinct(seed).alias("n_seeds"))


def sweep(df: DataFrame, keys: list[str], seed: str, value: str, flags: dict[str, Column]) -> DataFrame:
    """Mean over a seed's rows (languages), then mean and deviation over seeds; for each flag, in how many seeds any row has it."""
    per = df.groupBy(*keys, seed).agg(F.avg(value).alias("__m"), *[F.max(c.cast("int")).alias(n) for n, c in flags.items()])
    return per.groupBy(*keys).agg(F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("std"), *[F.sum(n).alias(n) for n in flags])


def means(df: DataFrame, keys: list[str], value: str, name: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def language_loss(df: DataFrame, keys: list[str], lang: str, loss: str, tokens: str) -> DataFrame:
    """loss: the sum over a batch's tokens. Mean of the languages' token means, and the token mean over all; perplexity is exp of the first."""
    per = df.groupBy(*keys, lang).agg(F.sum(loss).alias("__l"), F.sum(tokens).alias("__t"))
    return per.groupBy(*keys).agg(F.avg(F.col("__l") / F.col("__t")).alias("language_mean"), (F.sum("__l") / F.sum("__t")).alias("token_mean")).withColumn("perplexity", F.exp("language_mean"))


def best_epoch(df: DataFrame, keys: list[str], epoch: str, loss: str) -> DataFrame:
    """The epoch with the lowest mean loss (the earliest of equals), that loss, the last epoch, and whether the best one is early (one of the first two) or the last."""
    per = df.groupBy(*keys, epoch).agg(F.avg(loss).alias("__l"))
    got = per.groupBy(*keys).agg(F.min(F.struct(F.col("__l"), F.col(epoch).alias("e"))).alias("__b"), F.min(epoch).alias("__f"), F.max(epoch).alias("last_epoch"))
    e = F.col("__b.e")
    return got.select(*keys, e.alias("best_epoch"), F.col("__b.__l").alias("best_loss"), "last_epoch", (e <= F.col("__f") + 1).alias("early_best"), (e == F.col("last_epoch")).alias("last_best"))


def variant_difference(df: DataFrame, keys: list[str], variant: str, value: str, keep: str, drop: str) -> DataFrame:
    """value of one variant less that of another, for keys that have both: conditional means in one aggregation, no join."""
    got = df.groupBy(*keys).agg(*[F.avg(F.when(F.col(variant) == v, F.col(value))).alias(n) for v, n in ((keep, "kept"), (drop, "dropped"))])
    return got.where("kept IS NOT NULL AND dropped IS NOT NULL").withColumn("difference", F.col("kept") - F.col("dropped"))


def baseline_drop(df: DataFrame, target: str, value: str, pivot: str) -> DataFrame:
    """Mean by target, and how far it lies under the pivot's."""
    per = means(df, [target], value)
    top = per.where(F.col(target) == pivot).select(F.col("mean").alias("__p"))  # one row
    return per.join(F.broadcast(top)).select(target, "mean", (F.col("__p") - F.col("mean")).alias("drop"))


def overlap_restricted(df: DataFrame, keys: list[str], fact: str, system: str, a: str, b: str, correct: str = "correct") -> DataFrame:
    """Of the facts that both systems have and either gets right, the share that both do; 0 if there are none."""
    side = lambda s: F.max(F.when(F.col(system) == s, F.col(correct)))
    per = df.groupBy(*keys, fact).agg(side(a).alias("a"), side(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return per.groupBy(*keys).agg((F.sum(F.col("a") * F.col("b")) / F.greatest(F.sum(F.greatest("a", "b")), F.lit(1))).alias("overlap"), F.count("*").alias("n_common"))


def share_at_least(df: DataFrame, file: str, a: str, b: str) -> DataFrame:
    """One row: the mean over files of the share of rows with a >= b, over rows that have both."""
    per = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(file).agg(F.avg((F.col(a) >= F.col(b)).cast("int")).alias("__m"))
    return per.agg(F.avg("__m").alias("share"), F.count("*").alias("n_files"))


def positional(a: DataFrame, b: DataFrame, keys: list[str], line: str, columns: list[str], strict: bool = False) -> DataFrame:
    """Two systems' rows by line: column_a and column_b. strict raises where one has lines that the other lacks; else these go."""
    x = a.select(*keys, line, *[F.col(c).alias(f"{c}_a") for c in columns], F.lit(True).alias("__a"))
    y = b.select(*keys, line, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(True).alias("__b"))
    both = x.join(y, [*keys, line], "full" if strict else "inner")
    if strict:
        both = both.where(F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("one side has lines that the other lacks")).cast("boolean")).otherwise(True))
    return both.drop("__a", "__b")


def annotator_kappas(df: DataFrame, item: str, annotator: str, label: str, labels: list[str], least: int = 10) -> DataFrame:
    """Cohen's kappa of every two annotators with `least` or more items in common."""
    from .stats import cohen_kappa

    pairs = run_pairs(df, [item], annotator, label)
    return cohen_kappa(pairs, ["run_a", "run_b"], "value_a", "value_b", labels).where(F.col("n") >= least)


def extreme_row(df: DataFrame, keys: list[str], value: str, order: str, keep: list[str], largest: bool = True) -> DataFrame:
    """The row with the largest (smallest) value of each group, the first by order among equals; groups are cut map-side by a group limit."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value) if largest else F.asc(value), order)
    return df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*keys, value, *keep)


def top_by_count(df: DataFrame, keys: list[str], name: str, k: int) -> DataFrame:
    """Each group's k most frequent names, ties to the smaller name, with rank and count."""
    got = df.groupBy(*keys, name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), name)
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
