"""Choices among scored candidates; ties go to the first by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .running import numbered_within


def argmax_first(df: DataFrame, keys: list[str], score: str | Column, order: str, keep: list[str]) -> DataFrame:
    """The row with the highest score of each group, the first by order among equals. A group limit of one row cuts the groups before they are shuffled."""
    s = F.col(score) if isinstance(score, str) else score
    w = Window.partitionBy(*keys).orderBy(F.desc("__s"), F.asc(order))
    return df.withColumn("__s", s).withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*keys, *keep)


def length_normalised(score: Column, length: Column, alpha: Column | float) -> Column:
    return score / F.pow(length.cast("double"), F.lit(alpha) if isinstance(alpha, float | int) else alpha)


def dedupe_candidates(df: DataFrame, group: str, tokens: str, order: str, cap: int | None = None) -> DataFrame:
    """Of candidates with the same tokens the first stays; index counts them by first appearance. Longer than cap: out."""
    x = df.where(F.size(tokens) <= cap) if cap else df
    first = Window.partitionBy(group, tokens).orderBy(order)
    x = x.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    return numbered_within(x, [group], [order], "index").withColumn("index", F.col("index") - 1)


def drop_duplicates_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def relative_to_ends(df: DataFrame, group: list[str], order: list, value: str) -> DataFrame:
    """(value - last) / (first - last) along the order; a difference of 0 counts as 1."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(w), F.last(value).over(w)
    return df.withColumn("relative", (F.col(value) - last) / F.when(first == last, F.lit(1.0)).otherwise(first - last))


def running_best(df: DataFrame, group: list[str], epoch: str, loss: str, patience: int) -> DataFrame:
    """Lowest loss so far, epochs since it was last lowered, and whether training would have stopped by then."""
    w = Window.partitionBy(*group).orderBy(epoch)
    x = df.withColumn("best", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    prev = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("__at", F.when(prev.isNull() | (F.col(loss) < prev), F.col(epoch)))
    x = x.withColumn("__last", F.max("__at").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("since", F.col(epoch) - F.col("__last")).withColumn("stopped", F.max(F.col("since") >= patience).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__at", "__last")


def alpha_sweep(scores: DataFrame, example: str, candidate: str, score: str, length: str, gold: str, relation: str, alphas: list[float]) -> DataFrame:
    """Macro accuracy of the best candidate for each alpha of the length normalisation. The alphas are exploded in place: the
    argmax of all of them is one aggregation."""
    x = scores.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    x = x.withColumn("__s", length_normalised(F.col(score), F.col(length), F.col("alpha")))
    top = argmax_first(x, ["alpha", relation, example], "__s", candidate, [candidate, gold])
    per = top.groupBy("alpha", relation).agg(F.avg((F.col(candidate) == F.col(gold)).cast("int")).alias("__m"))
    return per.groupBy("alpha").agg(F.avg("__m").alias("macro"))


def beam(scores: DataFrame, width: int, *, example: str = "example", position: str = "position", prev: str = "prev", token: str = "token", score: str = "score") -> DataFrame:
    """example, rank (from 1), tokens (array), score: the `width` best token sequences of each example, found left to right.

    scores has a row for each token that may stand at a position after the token prev (null: after none), and what it adds to
    the sum. Positions are taken in ascending order, whatever their numbers. At each, every kept sequence is prolonged by each
    token that may follow its last one; one that none may follow stays as it is and competes with its sum. Equal sequences are
    merged, the highest sum stays, and equal sums are ordered by the tokens. Rows with a null in example, position, token or
    score take no part; no rows give no rows.

    A step is one join on (example, last token) and one group limit that cuts an example's candidates before they are
    shuffled. There are as many steps as positions, and each is written, so the plan does not grow with them.
    """
    x = scores.select(F.col(example).alias("example"), F.col(position).alias("__p"), F.col(prev).alias("__prev"), F.col(token).alias("__token"), F.col(score).alias("__add")).dropna(subset=["example", "__p", "__token", "__add"])
    x = written(x.groupBy("example", "__p", "__prev", "__token").agg(F.max("__add").alias("__add")), "beam-scores")
    kind = x.schema["__token"].dataType.simpleString()
    sum_kind = "double" if x.schema["__add"].dataType.simpleString() in ("float", "double") else "decimal(38,6)" if "decimal" in x.schema["__add"].dataType.simpleString() else "bigint"
    kept = x.select("example").distinct().select("example", F.array().cast(f"array<{kind}>").alias("tokens"), F.lit(0).cast(sum_kind).alias("score"))
    best = F.row_number().over(Window.partitionBy("example").orderBy(F.desc("score"), "tokens"))
    for p in sorted(r["__p"] for r in x.select("__p").distinct().collect()):  # as many as a sequence has tokens
        at = x.where(F.col("__p") == p).select(F.col("example").alias("__example"), "__prev", "__token", "__add")
        more = kept.join(at, (F.col("example") == F.col("__example")) & F.try_element_at("tokens", F.lit(-1)).eqNullSafe(F.col("__prev")), "left")
        tokens = F.when(F.col("__token").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array("__token")))
        more = more.select("example", tokens.alias("tokens"), (F.col("score") + F.coalesce("__add", F.lit(0))).cast(sum_kind).alias("score"))
        more = more.groupBy("example", "tokens").agg(F.max("score").alias("score"))
        kept = written(more.withColumn("rank", best).where(F.col("rank") <= width).select("example", "tokens", "score"), "beam-step")
    return kept.withColumn("rank", best).select("example", "rank", "tokens", "score")
