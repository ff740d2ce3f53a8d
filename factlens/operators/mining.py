"""Mention pairs, windows over tokens, and counts over mined text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .running import numbered_within, running


def mention_pairs(df: DataFrame, doc: str, mentions: str, ahead: int, gap: int) -> DataFrame:
    """Pairs of a mention and one of the next `ahead`, with 0 <= begin - end < gap. Within the row: no shuffle, no self-join.

    mentions: array of (ent, begin, end), sorted by begin."""
    x = df.select(doc, F.posexplode(mentions).alias("i", "a"), F.col(mentions).alias("__m"))
    x = x.select(doc, "i", "a", F.posexplode(F.slice("__m", F.col("i") + 2, ahead)).alias("k", "b"))
    d = F.col("b.begin") - F.col("a.end")
    return x.where((d >= 0) & (d < gap)).select(doc, F.col("a.ent").alias("ent_a"), F.col("b.ent").alias("ent_b"), F.col("i").alias("pos_a"), (F.col("i") + 1 + F.col("k")).alias("pos_b"), d.alias("gap"))


def either_direction(pairs: DataFrame, facts: DataFrame, a: str, b: str, sub: str, obj: str, relation: str) -> DataFrame:
    """Pairs that a fact links, in the order read or turned round."""
    f = facts.select(F.col(sub).alias("__s"), F.col(obj).alias("__o"), F.col(relation).alias("relation"))
    straight = pairs.join(f, (F.col(a) == F.col("__s")) & (F.col(b) == F.col("__o"))).withColumn("direction", F.lit("forward"))
    turned = pairs.join(f, (F.col(b) == F.col("__s")) & (F.col(a) == F.col("__o"))).withColumn("direction", F.lit("backward"))
    return straight.unionByName(turned).drop("__s", "__o")


def nearest(df: DataFrame, doc: str, left: str, right: str, most: int) -> DataFrame:
    """Smallest distance between two position arrays of a row, where it is at most `most`."""
    x = F.array_min(F.transform(left, lambda p: F.array_min(F.transform(right, lambda q: F.abs(p - q)))))
    return df.select(doc, x.alias("distance")).where(F.col("distance") <= most)


def segments(df: DataFrame, doc: str, pos: str, brk: str, sentence: int = 3, paragraph: int = 4) -> DataFrame:
    """Sentence and paragraph numbers from break codes; a paragraph break starts both."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    b = F.col(brk)
    return df.withColumn("sentence", F.sum(F.when(b.isin(sentence, paragraph), 1).otherwise(0)).over(w)).withColumn("paragraph", F.sum(F.when(b == paragraph, 1).otherwise(0)).over(w))


def claim_positions(mentions: str | Column) -> Column:
    """Of mentions (ent, begin, end) in order, those that overlap none taken before: the first claims its positions."""
    m = F.col(mentions) if isinstance(mentions, str) else mentions
    return F.aggregate(
        m,
        F.slice(m, 1, 0),
        lambda kept, x: F.when(F.exists(kept, lambda y: (x["begin"] < y["end"]) & (y["begin"] < x["end"])), kept).otherwise(F.concat(kept, F.array(x))),
    )


def islands(df: DataFrame, doc: str, pos: str, mark: str) -> DataFrame:
    """Runs of neighbouring positions with the same mark become one row: first, last, length."""
    w = Window.partitionBy(doc).orderBy(pos)
    same = F.lag(mark).over(w).eqNullSafe(F.col(mark))
    x = df.withColumn("__g", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(doc, "__g", mark).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("length")).drop("__g")


def char_offsets(tokens: str | Column) -> Column:
    """Where each token starts if they are joined by one blank."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    ends = F.aggregate(t, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(x) + 1)))
    return F.slice(ends, 1, F.size(t))


def token_blocks(df: DataFrame, doc: str, tokens: str, block: int) -> DataFrame:
    """Whole blocks of each document's tokens; the tail is dropped."""
    n = F.floor(F.size(tokens) / block).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.select(doc, F.posexplode(F.transform(at, lambda i: F.slice(F.col(tokens), i * block + 1, block))).alias("block", "tokens"))


def two_hop(df: DataFrame, sub: str, relation: str, obj: str) -> DataFrame:
    """Paths a -> b -> c of two facts."""
    a = df.select(F.col(sub).alias("a"), F.col(relation).alias("r1"), F.col(obj).alias("b"))
    b = df.select(F.col(sub).alias("b"), F.col(relation).alias("r2"), F.col(obj).alias("c"))
    return a.join(b, "b").where("a <> c").select("a", "r1", "b", "r2", "c")


def top_surface_form(df: DataFrame, keys: list[str], form: str, order: str) -> DataFrame:
    """Count of each key and its most frequent form, the first seen among equals."""
    per = df.groupBy(*keys, form).agg(F.count("*").alias("__n"), F.min(order).alias("__o"))
    return per.groupBy(*keys).agg(F.sum("__n").alias("n"), F.max_by(form, F.struct(F.col("__n"), -F.col("__o"))).alias("form"))


def greedy_capped(df: DataFrame, path: str, entities: list[str], score: str, cap: int, limit: int) -> DataFrame:
    """Within each path, by falling score (then by the entities): a row is taken unless one of its entities was taken `cap` times; the first `limit` taken rows stay.

    In rounds instead of row by row: an open row is surely taken if, for each of its entities, the open rows before it cannot use up what
    is left of the cap. Rows that an entity without rest has are out, and so are those after the `limit`th taken one. The first open row of each
    path is taken in every round, so it ends, with the rows of the serial rule. Counts run over ranges (see running), so a path or an entity with most of the rows is dealt over tasks.
    A null is an entity like any other; one that a row names twice is used twice."""
    rows = numbered_within(df.select(path, *entities, score), [path], [F.col(score).desc(), *entities], "__pos")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = written(rows.withColumn("__path", text(path)), "greedy-rows")
    uses = rows.select("__path", "__pos", F.explode(F.array(*[text(e) for e in entities])).alias("__name")).groupBy("__path", "__pos", "__name").agg(F.count("*").alias("__w"))
    uses = open_ = written(uses, "greedy-uses")
    key, taken = ["__path", "__pos"], None
    while not open_.isEmpty():
        x = running(open_, ["__path", "__name"], ["__pos"], {"__run": F.col("__w")})
        if taken is None:
            x = x.withColumn("__left", F.lit(cap))
        else:
            used = uses.join(taken, key, "left_semi").groupBy("__path", "__name").agg(F.sum("__w").alias("__used"))
            x = x.join(used, ["__path", "__name"], "left").withColumn("__left", F.lit(cap) - F.coalesce("__used", F.lit(0)))
        state = x.groupBy(*key).agg(F.min(F.col("__run") - F.col("__w") < F.col("__left")).alias("__sure"), F.min(F.col("__left") > 0).alias("__free"))
        state = written(state.where("__free"), "greedy-state")
        more = state.where("__sure").select(*key)
        taken = written(more if taken is None else taken.unionByName(more), "greedy-taken")
        nth = F.row_number().over(Window.partitionBy("__path").orderBy("__pos"))
        taken = written(taken.withColumn("__n", nth).where(F.col("__n") <= limit), "greedy-first")
        last = taken.where(F.col("__n") == limit).select("__path", F.col("__pos").alias("__last"))  # at most a row a path
        taken = taken.drop("__n")
        rest = state.where("NOT __sure").select(*key).join(last, "__path", "left").where("__last IS NULL OR __pos < __last")
        open_ = written(open_.join(rest, key, "left_semi"), "greedy-open")
    if taken is None:
        return rows.select(path, *entities, score).limit(0)
    return rows.join(taken, key, "left_semi").select(path, *entities, score)
