"""Facts joined to labels, aliases and objects, with the reasons why a fact is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written


def with_labels(facts: DataFrame, labels: DataFrame, langs: list[str], sub: str = "sub_uri", obj: str = "obj_uri") -> DataFrame:
    """sub_<lang> and obj_<lang> for each language, null where there is no label. labels: entity, lang, label.

    The label table is pivoted once (conditional maxima), so each side is one equi-join whatever the number of languages."""
    wide = labels.groupBy("entity").agg(*[F.max(F.when(F.col("lang") == x, F.col("label"))).alias(x) for x in langs])
    for side, key in (("sub", sub), ("obj", obj)):
        facts = facts.join(wide.select(F.col("entity").alias("__e"), *[F.col(x).alias(f"{side}_{x}") for x in langs]), F.col(key) == F.col("__e"), "left").drop("__e")
    return facts


def fallback(*columns: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in (F.col(x) if isinstance(x, str) else x for x in columns)])


def joint_fallback(sub: str, obj: str, sub_else: str, obj_else: str) -> tuple[Column, Column]:
    """Both in the language if both are there, else both in the other."""
    both = F.col(sub).isNotNull() & F.col(obj).isNotNull()
    return F.when(both, F.col(sub)).otherwise(F.col(sub_else)), F.when(both, F.col(obj)).otherwise(F.col(obj_else))


def portion(df: DataFrame, sub: str, obj: str, which: str) -> DataFrame:
    """trans: facts with both labels; non: the others; all."""
    both = F.col(sub).isNotNull() & F.col(obj).isNotNull()
    if which not in ("trans", "non", "all"):
        raise ValueError(f"portion {which}: trans, non or all")
    return df if which == "all" else df.where(both if which == "trans" else ~both)


def restricted(facts: DataFrame, pairs: DataFrame, triples: DataFrame, relation: str, sub: str, obj: str) -> DataFrame:
    """Facts whose (relation, subject) pair or whose triple is listed. Marked by two joins and kept once."""
    p = pairs.select(relation, sub).distinct().withColumn("__p", F.lit(True))
    t = triples.select(relation, sub, obj).distinct().withColumn("__t", F.lit(True))
    return facts.join(p, [relation, sub], "left").join(t, [relation, sub, obj], "left").where("__p OR __t").drop("__p", "__t")


def gold_answers(facts: DataFrame, aliases: DataFrame, objects: DataFrame, fact: str, relation: str, sub: str, obj: str, label: str) -> DataFrame:
    """fact, gold: the object's label and aliases, and those of the subject's other objects. aliases: entity, alias; objects: sub, relation, obj."""
    own = facts.select(fact, F.col(obj).alias("entity"), F.col(label).alias("__l"))
    more = facts.select(fact, relation, F.col(sub).alias("__s")).join(objects.select(F.col(relation), F.col(sub).alias("__s"), F.col(obj).alias("entity")), [relation, "__s"]).select(fact, "entity")
    named = own.select(fact, "entity").unionByName(more).distinct().join(aliases, "entity").select(fact, F.col("alias").alias("gold"))
    return named.unionByName(own.select(fact, F.col("__l").alias("gold"))).where("gold IS NOT NULL").distinct()


def reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """reason: the name of the first rule that holds, null for a fact that is kept."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return df.withColumn("reason", out)


def redirect_ends(redirects: DataFrame) -> DataFrame:
    """source, target (where its chain of redirects ends), looped (it never ends; then the target is the source itself). Of several targets of a source the smallest counts.

    By pointer doubling: each round every pointer takes its target's pointer, so chains of any length take as many rounds as their length has binary
    digits. Of chains that end, the longest open ones end in the next round; when a round ends none, all that are open run in circles."""
    at = written(redirects.where("source IS NOT NULL AND target IS NOT NULL").groupBy("source").agg(F.min("target").alias("target")), "redirects")
    origin, was = at.select("source"), -1
    while True:
        open_ = at.join(origin.withColumnRenamed("source", "target"), "target", "left_semi").count()
        if open_ in (0, was):
            break
        was = open_
        hop = at.select(F.col("source").alias("target"), F.col("target").alias("__next"))
        at = written(at.join(hop, "target", "left").select("source", F.coalesce("__next", "target").alias("target")), "redirects")
    loops = origin.select(F.col("source").alias("target"), F.lit(True).alias("looped"))
    return at.join(loops, "target", "left").select("source", F.when(F.col("looped"), F.col("source")).otherwise(F.col("target")).alias("target"), F.coalesce("looped", F.lit(False)).alias("looped"))


def resolve_redirects(ids: DataFrame, redirects: DataFrame, key: str) -> DataFrame:
    """target: where the redirects lead from key, however many there are, key itself without any; reason: loop where they never end, else null. redirects: source, target."""
    ends = redirect_ends(redirects).select(F.col("source").alias(key), F.col("target").alias("__t"), F.when(F.col("looped"), "loop").alias("reason"))
    return ids.join(ends, key, "left").withColumn("target", F.coalesce("__t", key)).drop("__t")


def two_system_classes(a: DataFrame, b: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    """seen: both, first, second or none, for every fact."""
    x = every.select(*keys).distinct().withColumn("__w", F.lit(0)).unionByName(a.select(*keys).distinct().withColumn("__w", F.lit(1))).unionByName(b.select(*keys).distinct().withColumn("__w", F.lit(2)))
    got = x.groupBy(*keys).agg(F.max(F.col("__w") == 1).alias("__a"), F.max(F.col("__w") == 2).alias("__b"))
    return got.select(*keys, F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "first").when(F.col("__b"), "second").otherwise("none").alias("seen"))
