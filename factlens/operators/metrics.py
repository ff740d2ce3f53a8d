"""Accuracy metrics over prediction tables. Every function is one or two aggregations with map-side partial sums; the second
level has a row for each group of the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ((1, "1"), (2, "2"), (4, "3-4"), (None, "5+"))


def length_bucket(length: Column, edges=BUCKETS) -> Column:
    """The first bucket whose upper edge is not exceeded."""
    out = F.lit(edges[-1][1])
    for top, name in reversed(edges[:-1]):
        out = F.when(length <= top, name).otherwise(out)
    return F.when(length.isNotNull(), out)


def two_level(df: DataFrame, outer: list[str], inner: list[str], value: str, name: str = "value") -> DataFrame:
    """Mean over the inner groups of their means, their sample deviation, and how many there are. One group: null deviation."""
    first = df.groupBy(*outer, *inner).agg(F.avg(value).alias("__m"))
    return first.groupBy(*outer).agg(F.avg("__m").alias(f"{name}_mean"), F.stddev_samp("__m").alias(f"{name}_std"), F.count("__m").alias("n_groups"))


def em_by_length(df: DataFrame, keys: list[str], seed: str = "seed", correct: str = "correct", length: str = "gold_len", edges=BUCKETS) -> DataFrame:
    """Exact match by length bucket: a mean for each seed, then mean and deviation over seeds; n is the mean count."""
    rows = df.withColumn("bucket", length_bucket(F.col(length), edges))
    first = rows.groupBy(*keys, "bucket", seed).agg(F.avg(correct).alias("__m"), F.count("*").alias("__n"))
    return first.groupBy(*keys, "bucket").agg(F.avg("__m").alias("em_mean"), F.stddev_samp("__m").alias("em_std"), F.avg("__n").alias("n"))


def subset_metrics(df: DataFrame, keys: list[str], relation: str = "relation", correct: str = "correct", length: str = "gold_len") -> DataFrame:
    """Macro and micro exact match of all, single- and multi-token answers; a relation without rows in a subset is left out."""
    kind = F.when(F.col(length) <= 1, "single").otherwise("multi")
    rows = df.withColumn("subset", F.explode(F.array(F.lit("all"), kind)))
    first = rows.groupBy(*keys, "subset", relation).agg(F.sum(correct).alias("__k"), F.count("*").alias("__n"))
    return first.groupBy(*keys, "subset").agg(F.avg(F.col("__k") / F.col("__n")).alias("macro"), (F.sum("__k") / F.sum("__n")).alias("micro"), F.sum("__n").alias("n"), F.count("*").alias("num_relations"))


def relation_accuracy(df: DataFrame, relation: str = "relation", correct: str = "correct", length: str = "gold_len") -> DataFrame:
    """Accuracy of all, single and multi by relation; an empty subset counts as 0 of 1."""
    single = F.col(length) <= 1
    c, one = F.col(correct), F.lit(1)
    return df.groupBy(relation).agg(*[(F.coalesce(F.sum(F.when(w, c)), F.lit(0)) / F.greatest(F.count(F.when(w, one)), one)).alias(n) for n, w in (("acc_all", F.lit(True)), ("acc_single", single), ("acc_multi", ~single))])


def macro_with_zeros(df: DataFrame, **columns) -> DataFrame:
    """Mean over all relations, where a relation without single (multi) answers adds 0."""
    return relation_accuracy(df, **columns).agg(*[F.avg(c).alias(c) for c in ("acc_all", "acc_single", "acc_multi")])


def chance_level(candidates: DataFrame, relation: str, key: str) -> DataFrame:
    return candidates.groupBy(relation).agg(F.countDistinct(key).alias("__n")).agg(F.avg(1.0 / F.greatest("__n", F.lit(1))).alias("chance"))


def oracle_accuracy(df: DataFrame, relation: str, fact: str, correct: str = "correct") -> DataFrame:
    """Facts that any prompt gets right, by relation."""
    per = df.groupBy(relation, fact).agg(F.max(correct).alias("__c"))
    return per.groupBy(relation).agg(F.sum("__c").alias("n_correct"), F.count("*").alias("n_facts"), (F.sum("__c") / (F.count("*") + F.lit(1e-10))).alias("oracle"))


def overlap_histogram(df: DataFrame, fact: str, lang: str, keys: list[str], correct: str = "correct") -> DataFrame:
    """Of the facts scored in every language, the share that is right in 0, 1, ... languages, with the empty bins."""
    n_langs = df.select(lang).distinct().agg(F.count("*").alias("__l"))
    per = df.groupBy(*keys, fact).agg(F.count("*").alias("__n"), F.sum(correct).cast("int").alias("k")).crossJoin(F.broadcast(n_langs)).where("__n = __l")  # n_langs is one row
    hist = per.groupBy(*keys, "k").agg(F.count("*").alias("n"))
    bins = hist.select(*keys).distinct().crossJoin(F.broadcast(n_langs)).select(*keys, F.explode(F.sequence(F.lit(0), F.col("__l").cast("int"))).alias("k"))
    out = bins.join(hist, [*keys, "k"], "left").na.fill(0, ["n"])
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def pairwise_overlap(df: DataFrame, fact: str, lang: str, keys: list[str], correct: str = "correct") -> DataFrame:
    """For language pairs a < b on facts both have: facts right in both, in either, and their ratio (null if none).

    Each fact's languages are gathered in one array (as long as there are languages), so no self-join is shuffled."""
    per = df.groupBy(*keys, fact).agg(F.sort_array(F.collect_list(F.struct(F.col(lang).alias("l"), F.col(correct).alias("c")))).alias("__x"))
    one = per.select(*keys, F.posexplode("__x").alias("i", "p"), "__x")
    two = one.select(*keys, F.col("p").alias("p"), F.explode(F.slice("__x", F.col("i") + 2, F.size("__x"))).alias("q"))
    both, any_ = F.col("p.c") * F.col("q.c"), F.greatest("p.c", "q.c")
    out = two.groupBy(*keys, F.col("p.l").alias("lang_a"), F.col("q.l").alias("lang_b")).agg(F.sum(both).alias("n_both"), F.sum(any_).alias("n_any"), F.count("*").alias("n"))
    return out.withColumn("jaccard", F.col("n_both") / F.when(F.col("n_any") > 0, F.col("n_any")))


def language_count_distribution(df: DataFrame, fact: str, lang: str, correct: str = "correct") -> DataFrame:
    """Of the facts right anywhere, the share by number of languages."""
    per = df.where(F.col(correct) == 1).groupBy(fact).agg(F.countDistinct(lang).alias("n_langs"))
    return per.groupBy("n_langs").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def transfer_given(df: DataFrame, fact: str, lang: str, pivot_lang: str, keys: list[str], correct: str = "correct") -> DataFrame:
    """P(right in a language | right in pivot_lang)."""
    base = df.where((F.col(lang) == pivot_lang) & (F.col(correct) == 1)).select(*keys, fact).distinct()
    rows = df.where(F.col(lang) != pivot_lang).join(base, [*keys, fact], "left_semi")
    return rows.groupBy(*keys, lang).agg(F.avg(correct).alias("p_given"), F.count("*").alias("n"))


def fertility(df: DataFrame, fact_keys: list[str], by: list[str], length: str = "gold_len", scored: str | None = None) -> DataFrame:
    """Mean answer length and share of multi-token answers over distinct facts, with scored and skipped counts."""
    one = df.groupBy(*by, *fact_keys).agg(F.min(length).alias("__n"), (F.max(scored) if scored else F.lit(1)).alias("__s"))
    return one.groupBy(*by).agg(F.avg("__n").alias("mean_tokens"), F.avg((F.col("__n") > 1).cast("int")).alias("share_multi"), F.sum("__s").alias("n_scored"), F.sum(1 - F.col("__s")).alias("n_skipped"))


def zero_filled_histogram(df: DataFrame, value: str, top: int, name: str = "n") -> DataFrame:
    got = df.groupBy(F.col(value).cast("int").alias("bin")).agg(F.count("*").alias(name))
    bins = df.sparkSession.range(1, top + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(got, "bin", "left").na.fill(0, [name])


def language_coverage(facts: DataFrame, lang: str, relation: str, total: int | Column) -> DataFrame:
    """Usable facts, their share of all, relations represented, and the least and most facts of one; 0 where there are none."""
    per = facts.groupBy(lang, relation).agg(F.count("*").alias("__n"))
    return per.groupBy(lang).agg(F.sum("__n").alias("n_facts"), F.count("*").alias("n_relations"), F.min("__n").alias("min_facts"), F.max("__n").alias("max_facts")).withColumn("coverage", F.col("n_facts") / total)


def counts_by_part(df: DataFrame, key: str, part: str, parts: list[str]) -> DataFrame:
    """A row for each key: total and the count of each part, 0 where there are none."""
    return df.groupBy(key).agg(F.count("*").alias("total"), *[F.count(F.when(F.col(part) == p, 1)).alias(f"n_{p}") for p in parts])


def gains(df: DataFrame, keys: list[str], system: str, baseline: str, value: str) -> DataFrame:
    """Each system's value less the baseline's; null without one. The baseline is found in the same group, without a join."""
    base = F.max(F.when(F.col(system) == baseline, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("gain", F.col(value) - base)


def win_loss(df: DataFrame, relation: str, a: str, b: str) -> DataFrame:
    """By relation: rows that only a, only b, both or neither have right."""
    x, y = F.col(a) == 1, F.col(b) == 1
    one = F.lit(1)
    return df.groupBy(relation).agg(F.count(F.when(x & ~y, one)).alias("wins"), F.count(F.when(~x & y, one)).alias("losses"), F.count(F.when(x & y, one)).alias("both"), F.count(F.when(~x & ~y, one)).alias("neither"))


def normalised_ranks(df: DataFrame, group: str, order: list, hit: str, bins: int = 10) -> DataFrame:
    """Histogram of (rank - 1) / n of the rows with hit = 1; the last bin is closed."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("__r", (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w)).where(F.col(hit) == 1)
    return ranked.groupBy(F.least(F.floor(F.col("__r") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, a: str, b: str, labels: list) -> DataFrame:
    """Counts of b's labels by a's, with every label on both sides."""
    got = df.groupBy(F.col(a).alias("label")).agg(*[F.count(F.when(F.col(b) == v, 1)).alias(f"n_{v}") for v in labels])
    every = df.sparkSession.createDataFrame([(v,) for v in labels], df.select(F.col(a).alias("label")).schema)
    return every.join(got, "label", "left").na.fill(0)


def crosstab_shares(df: DataFrame, row: str, column: str) -> DataFrame:
    got = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def token_accuracy(df: DataFrame, order: list, batch: int, hits: str, tokens: str) -> DataFrame:
    """The mean of the batches' accuracies, and accuracy over all tokens. A batch is `batch` rows in a row by order (splits.every_n)."""
    from .splits import every_n

    per = every_n(df, order, batch, "__b").groupBy("__b").agg(F.sum(hits).alias("__h"), F.sum(tokens).alias("__t"))
    return per.agg(F.avg(F.col("__h") / F.col("__t")).alias("batch_mean"), (F.sum("__h") / F.sum("__t")).alias("micro"))


def transfer_by_bucket(df: DataFrame, fact: list[str], lang: str, pivot_lang: str, keys: list[str], seed: str, bucket: str, buckets: list[str], correct: str = "correct") -> DataFrame:
    """keys, lang, bucket, p_mean, p_std, n: P(right in a language | right in pivot_lang) by bucket and seed, then its mean and deviation over seeds. A language that a seed scored has every bucket; an empty one has no p (it does not count in p_mean) and n 0. One conditional aggregate makes all buckets, so there is no grid to join."""
    base = df.where((F.col(lang) == pivot_lang) & (F.col(correct) == 1)).select(*keys, seed, *fact).distinct().withColumn("__given", F.lit(True))
    rows = df.where(F.col(lang) != pivot_lang).join(base, [*keys, seed, *fact], "left")
    of = lambda b: F.col("__given") & (F.col(bucket) == b)
    cells = [F.struct(F.lit(b).alias("bucket"), F.avg(F.when(of(b), F.col(correct))).alias("p"), F.count(F.when(of(b), 1)).alias("n")) for b in buckets]
    per = rows.groupBy(*keys, seed, lang).agg(F.array(*cells).alias("__c")).select(*keys, lang, F.explode("__c").alias("c"))
    return per.groupBy(*keys, lang, F.col("c.bucket").alias("bucket")).agg(F.avg("c.p").alias("p_mean"), F.stddev_samp("c.p").alias("p_std"), F.avg("c.n").alias("n"))


def complete_jaccard(df: DataFrame, fact: str, lang: str, keys: list[str], seed: str, correct: str = "correct") -> DataFrame:
    """keys, lang_a, lang_b, jaccard_mean: pairwise_overlap on the facts that the seed scored in all of its languages, averaged over seeds; seeds without any right answer in the two do not count."""
    per = df.groupBy(*keys, seed, fact).agg(F.countDistinct(lang).alias("__n"))
    every = df.groupBy(*keys, seed).agg(F.countDistinct(lang).alias("__l"))
    whole = per.join(every, [*keys, seed]).where("__n = __l").select(*keys, seed, fact)
    out = pairwise_overlap(df.join(whole, [*keys, seed, fact], "left_semi"), fact, lang, [*keys, seed], correct)
    return out.groupBy(*keys, "lang_a", "lang_b").agg(F.avg("jaccard").alias("jaccard_mean"))
