"""Paired tests, calibration and agreement."""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided binomial test of b against c discordant pairs; 1 if there are none, null if either is null.

    The tail's largest term comes from log-gammas, the terms below it from their ratios, in stretches until they no longer
    count: work by the square root of the number of pairs, memory by one stretch."""

    def two_sided(b: pd.Series, c: pd.Series) -> pd.Series:
        def p_value(n: int, k: int) -> float:
            log_term = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2)
            total, i = exp(log_term), k
            while i > 0:
                at = np.arange(i, max(i - 8192, 0), -1, dtype=float)
                logs = log_term + np.cumsum(np.log(at) - np.log(n - at + 1))  # of the terms i - 1, i - 2, ...
                total, log_term, i = total + float(np.exp(logs).sum()), float(logs[-1]), int(at[-1]) - 1
                if exp(log_term) <= total * 1e-18:
                    break
            return min(1.0, 2 * total)

        known = b.notna() & c.notna()
        return pd.Series([(p_value(int(x + y), int(min(x, y))) if x + y else 1.0) if ok else None for x, y, ok in zip(b, c, known, strict=True)], dtype=float)

    return F.pandas_udf(two_sided, "double")(b.cast("long"), c.cast("long"))


def mcnemar(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Discordant pairs of two 0/1 columns, and the test."""
    x, y = F.col(a) == 1, F.col(b) == 1
    got = df.groupBy(*keys).agg(F.count(F.when(x & ~y, 1)).alias("only_a"), F.count(F.when(~x & y, 1)).alias("only_b"))
    return got.withColumn("p_value", mcnemar_p(F.col("only_a"), F.col("only_b")))


def calibration_bins(df: DataFrame, keys: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Equal bins of confidence, the last one closed."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct).alias("accuracy"))


def expected_calibration_error(df: DataFrame, keys: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Empty bins are skipped (they have no mean to be wrong about)."""
    x = calibration_bins(df, keys, confidence, correct, bins)
    return x.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def cohen_kappa(df: DataFrame, keys: list[str], a: str, b: str, labels: list) -> DataFrame:
    """Agreement beyond chance over a fixed set of labels; null without rows or if chance alone agrees always. One pass: the
    marginals are conditional counts."""
    one = F.lit(1)
    counts = [f(F.col(s) == v, n) for v in labels for s, n in ((a, f"__a_{v}"), (b, f"__b_{v}")) for f in (lambda w, n: F.count(F.when(w, one)).alias(n),)]
    got = df.groupBy(*keys).agg(F.count(F.when(F.col(a) == F.col(b), one)).alias("agree"), F.count("*").alias("n"), *counts)
    n = F.col("n").cast("double")
    chance = sum((F.col(f"__a_{v}") * F.col(f"__b_{v}") for v in labels), F.lit(0)) / (n * n)
    po = F.col("agree") / n
    return got.select(*keys, "n", po.alias("agreement"), ((po - chance) / F.when(chance < 1, 1 - chance)).alias("kappa"))


def bootstrap_difference(df: DataFrame, keys: list[str], relation: str, a: str, b: str, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """Stratified bootstrap of the macro difference mean(b) - mean(a): within each relation rows are drawn again with
    replacement. A relation's rows only matter by how many have each pair of values, so each replicate is a multinomial draw
    of those counts: what comes to a task is one row for each (key, relation, pair), however many facts there are."""
    import numpy as np

    counts = df.groupBy(*keys, relation, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b")).agg(F.count("*").alias("__n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        diff = np.zeros(replicates)
        point = 0.0
        groups = list(pdf.sort_values([relation, "__a", "__b"]).groupby(relation, sort=True))
        for _, g in groups:
            d, n = (g["__b"] - g["__a"]).to_numpy(), g["__n"].to_numpy()
            diff += rng.multinomial(int(n.sum()), n / n.sum(), replicates) @ d / n.sum() / len(groups)
            point += float(n @ d / n.sum() / len(groups))
        p = min(1.0, 2 * min((diff <= 0).mean(), (diff >= 0).mean()))
        low, high = np.percentile(diff, [2.5, 97.5])
        return pd.DataFrame([[*pdf[keys].iloc[0], point, low, high, p]], columns=[*keys, "difference", "low", "high", "p_value"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return counts.groupBy(*keys).applyInPandas(draw, f"{kinds}, difference double, low double, high double, p_value double")


def calibration_by_stratum(df: DataFrame, keys: list[str], confidence: str, correct: str, length: str, bins: int = 10) -> DataFrame:
    """keys, stratum (all, single, multi by answer length), ece (empty bins skipped), n, and ece_strict: null where a bin is empty, which has no mean."""
    x = df.select("*", F.explode(F.array(F.lit("all"), F.when(F.col(length) <= 1, "single").otherwise("multi"))).alias("stratum"))
    b = calibration_bins(x, [*keys, "stratum"], confidence, correct, bins)
    out = b.groupBy(*keys, "stratum").agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"), F.count("*").alias("__b"))
    return out.withColumn("ece_strict", F.when(F.col("__b") == bins, F.col("ece"))).drop("__b")
