"""Probe examples from facts, templates and labels, with the reason why a fact gives none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import fill_role
from .resolve import reasons


def with_entity(facts: DataFrame, key: str, labels: DataFrame, sexes: DataFrame, kinds: DataFrame, prefix: str) -> DataFrame:
    """<prefix>_label (null if there is none), <prefix>_sex (none) and <prefix>_kind (empty) of an entity column. The tables are (uri, label), (uri, sex), (uri, kind), one row an entity."""
    out = facts
    for df, column, name, default in ((labels, "label", f"{prefix}_label", None), (sexes, "sex", f"{prefix}_sex", "none"), (kinds, "kind", f"{prefix}_kind", "")):
        out = out.join(df.select(F.col("uri").alias(key), F.col(column).alias(name)), key, "left")
        out = out.na.fill(default, [name]) if default is not None else out
    return out


def build_examples(facts: DataFrame, templates: DataFrame, labels: DataFrame, sexes: DataFrame, kinds: DataFrame, lang: str, most_masks: int, tokens: Callable[[Column], Column], unknown: str = "[UNK]") -> DataFrame:
    """One row a fact (relation, sub, obj) whose relation has a template: prompt with masks, answer, n_masks (null where there is a reason), and reason.

    reason is null for an example; else the first of: no_subject, no_object (no label), empty (the answer has no tokens),
    unknown (one of them is unknown). n_masks is the answer's tokens, at most most_masks. Facts of relations without a
    template are left out. The answer is the label as the language puts it, so its tokens are counted after filling.
    """
    x = facts.join(templates.select("relation", "template"), "relation")
    x = with_entity(with_entity(x, "sub", labels, sexes, kinds, "sub"), "obj", labels, sexes, kinds, "obj")
    x = fill_role(x, lang, "x", "template", "sub_label", sex="sub_sex", instance="sub_kind", names=("half", "subject"))
    x = fill_role(x, lang, "y", "half", "obj_label", sex="obj_sex", instance="obj_kind", names=("whole", "answer"))
    x = x.withColumn("answer_tokens", tokens(F.col("answer"))).withColumn("n_masks", F.least(F.size("answer_tokens"), F.lit(most_masks)))
    x = fill_role(x, lang, "y", "half", "obj_label", sex="obj_sex", instance="obj_kind", masks=F.col("n_masks"), names=("prompt", "again"))
    rules = [("no_subject", F.col("sub_label").isNull()), ("no_object", F.col("obj_label").isNull()), ("empty", F.size("answer_tokens") == 0), ("unknown", F.array_contains("answer_tokens", unknown))]
    built = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return reasons(x, rules).select("relation", "sub", "obj", built("prompt"), built("answer"), built("n_masks"), "reason")


def token_length(tokens: Column) -> Column:
    """single or multi; null for no tokens."""
    n = F.size(tokens)
    return F.when(n == 1, "single").when(n > 1, "multi")


def length_partition(df: DataFrame, relation: str, length: str) -> DataFrame:
    """relation, n_single, n_multi, n_none, mean_length, max_length, complete (each fact is in one of the two parts)."""
    n = F.col(length)
    count = lambda c: F.count(F.when(c, 1))
    x = df.groupBy(relation).agg(count(n == 1).alias("n_single"), count(n > 1).alias("n_multi"), count(n.isNull() | (n < 1)).alias("n_none"), F.avg(n).alias("mean_length"), F.max(n).alias("max_length"), F.count("*").alias("n"))
    return x.select(relation, "n_single", "n_multi", "n_none", "mean_length", "max_length", (F.col("n_single") + F.col("n_multi") == F.col("n")).alias("complete"))


def document_hits(mentions: DataFrame, subjects: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each document (mentions: doc, sentence, paragraph, entity; subjects: doc, sub, the document's own subject) and each property of its subject (facts: sub, property, tail), the mention of a tail that is nearest in kind: in a sentence with the subject (grain 1), else in a paragraph with it (2); then the first sentence and the smallest tail. One aggregate over struct keys decides, which combines map-side."""
    own = mentions.join(subjects, "doc").where(F.col("entity") == F.col("sub")).select("doc", "sentence", "paragraph")
    of = mentions.join(subjects, "doc").join(facts.withColumnRenamed("tail", "entity"), ["sub", "entity"])
    near = of.join(own.select("doc", "sentence").distinct().withColumn("same", F.lit(1)), ["doc", "sentence"], "left")
    near = near.join(own.select("doc", "paragraph").distinct().withColumn("close", F.lit(2)), ["doc", "paragraph"], "left")
    near = near.withColumn("grain", F.coalesce("same", "close")).where("grain IS NOT NULL")
    best = near.groupBy("doc", "property").agg(F.min(F.struct("grain", "sentence", "entity")).alias("b"))
    return best.select("doc", "property", F.col("b.entity").alias("tail"), F.col("b.grain").alias("grain"), F.col("b.sentence").alias("sentence"))


def exact_sample(df: DataFrame, group: list[str], key: str, n: int, seed: int | str) -> DataFrame:
    """n rows of each group, by hash order; a group that has fewer raises. The sample is the feature."""
    from .splits import sample_per_group

    few = df.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") < n).select(F.raise_error(F.concat(F.lit("too few rows in "), F.concat_ws("/", *group))).cast("boolean").alias("ok"))
    checked = F.broadcast(few.agg(F.count("ok").alias("__few")))  # one row
    return sample_per_group(df, group, key, n, seed).join(checked).drop("__few")


def newest(df: DataFrame, run: str, name: str, n: int) -> DataFrame:
    """The n entries of each run with the largest number at the end of their name, as checkpoints are kept. Names without one are left alone (not returned)."""
    from pyspark.sql import Window

    x = df.withColumn("step", F.regexp_extract(name, r"-([0-9]+)$", 1)).where("step <> ''").withColumn("step", F.col("step").cast("long"))
    w = Window.partitionBy(run).orderBy(F.desc("step"), F.desc(name))
    return x.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def side_by_side(df: DataFrame, keys: list[str], system: str, value: str, systems: list[str], minus: tuple[str, str]) -> DataFrame:
    """One row a key with each system's value (null where it has none) and the difference of two of them: joins on several keys as one conditional aggregate."""
    x = df.groupBy(*keys).agg(*[F.max(F.when(F.col(system) == s, F.col(value))).alias(s) for s in systems])
    return x.withColumn("difference", F.col(minus[0]) - F.col(minus[1]))


def enriched(df: DataFrame, others: list[tuple[DataFrame, str]], keys: list[str]) -> DataFrame:
    """Left joins on the keys; columns of each other table that df has too get its suffix."""
    for other, suffix in others:
        other = other.select(*keys, *[F.col(c).alias(c + suffix if c in df.columns else c) for c in other.columns if c not in keys])
        df = df.join(other, keys, "left")
    return df


def averaged_gain(df: DataFrame, keys: list[str], lang: str, value: str, base: str) -> DataFrame:
    """Means over languages of a value and of its gain over a base column; languages without either do not count."""
    both = df.where(F.col(value).isNotNull() & F.col(base).isNotNull())
    return both.groupBy(*keys).agg(F.avg(value).alias("mean"), F.avg(F.col(value) - F.col(base)).alias("gain"), F.countDistinct(lang).alias("n_langs"))


def rebalanced(df: DataFrame, lang: str, fact: str, order: str, most: int, seed: int | str) -> DataFrame:
    """Rows of each language thinned to about `most`, by hash; the first row of each fact always stays. Languages with fewer stay whole."""
    from .splits import shuffled

    size = df.groupBy(lang).agg(F.count("*").alias("__n"))
    first = df.groupBy(lang, fact).agg(F.min(order).alias("__first"))
    x = df.join(F.broadcast(size), lang).join(first, [lang, fact])
    share = F.conv(F.substring(shuffled(seed, lang, order), 1, 4), 16, 10).cast("int") / 65536.0
    return x.where((F.col(order) == F.col("__first")) | (share < F.lit(most) / F.col("__n"))).drop("__n", "__first")


IGNORED = -100  # fixed value: the label of a place that is not predicted
_SPAN = 16**7


def _draws(seed: int | str, keys: list[str], at: Column) -> list[Column]:
    """Three independent whole numbers under 16^7 for each row and place, the same in every run."""
    from .splits import shuffled

    digest = shuffled(seed, *keys, at)
    return [F.conv(F.substring(digest, i, 7), 16, 10).cast("long") for i in (1, 8, 15)]


def masked_tokens(df: DataFrame, keys: list[str], tokens: str, seed: int | str, rate: float, mask_id: int, vocabulary: int, *, mentions: str | None = None, mention_rate: float | None = None, never: tuple[int, ...] = ()) -> DataFrame:
    """df with inputs and labels (arrays of long) for masked training: a place is drawn at `rate`, inside mentions (array of
    boolean, null or too short: false) at mention_rate where that is given; of the drawn, 80 % become mask_id, 10 % any id of
    the vocabulary, 10 % stay. Labels hold the token at drawn places, else IGNORED. Tokens of never, and null tokens, are not drawn.

    The draws are hashes of the seed, the keys and the place, so a row that is computed again gets the same; rows that share
    their keys share their draws. Null tokens give null arrays, no tokens empty ones.
    """
    drawn = F.lit(int(rate * _SPAN))
    if mentions and mention_rate:
        inside = lambda i: F.coalesce(F.get(mentions, i), F.lit(False))
        limit = lambda i: F.when(inside(i), int(mention_rate * _SPAN)).otherwise(drawn)
    else:
        limit = lambda i: drawn

    def one(t: Column, i: Column) -> Column:
        chance, kind, other = _draws(seed, keys, i)
        free = t.isNotNull() & ~t.isin(*never) if never else t.isNotNull()
        new = F.when(kind < int(0.8 * _SPAN), F.lit(mask_id).cast("long")).when(kind < int(0.9 * _SPAN), F.pmod(other, F.lit(vocabulary))).otherwise(t.cast("long"))
        hit = free & (chance < limit(i))
        return F.struct(F.when(hit, new).otherwise(t.cast("long")).alias("input"), F.when(hit, t.cast("long")).otherwise(F.lit(IGNORED).cast("long")).alias("label"))

    x = df.withColumn("__m", F.transform(tokens, one))
    return x.withColumns({"inputs": F.col("__m.input"), "labels": F.col("__m.label")}).drop("__m")


def raw_or_switched(df: DataFrame, keys: list[str], raw: str, switched: str, seed: int | str, raw_rate: float, name: str) -> DataFrame:
    """name: the raw form at raw_rate, else the switched one, by a hash of the seed and the keys."""
    return df.withColumn(name, F.when(_draws(seed, keys, F.lit("form"))[0] < int(raw_rate * _SPAN), F.col(raw)).otherwise(F.col(switched)))
