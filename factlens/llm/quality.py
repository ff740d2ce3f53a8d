"""Operator 12: document quality by a sparse ensemble of rules over text statistics.

Statistics of each text (shares of letters, cases, marks, repeats, lines) are column expressions. On a bounded sample of labelled
rows, short regression trees are boosted on the logistic loss; every path from a root to a node below it is a rule, a conjunction
of thresholds on statistics. A logistic model with an L1 penalty over all rules keeps few of them. The kept rules and weights
are compiled into one column expression, so scoring is a scan without Python, shuffle or state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc

#: At most so many labelled rows come to the driver, a few numbers each.
MAX_FIT_DOCS = 20_000
TREES, DEPTH, SHRINK, SHARE, BINS = 60, 3, 0.1, 0.5, 32
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001)
#: A rule has to hold for at least this share of the fitted rows, and to fail for as many.
LEAST = 0.005


STATISTICS = (
    "log_chars", "chars_per_word", "letter_share", "upper_share", "digit_share", "symbols_per_word", "bars_per_word", "shouts_per_word", "stops_per_word",
    "repeated_word_share", "distinct_word_share", "repeated_line_share", "words_per_line",
)


def with_statistics(docs: DataFrame, text_col: str, keep: list[Column], out: str) -> DataFrame:
    """The columns of keep, and out: the numbers of STATISTICS of the text as one array, never null. A null text counts as empty; what would be divided by nothing is divided by one.

    In three steps, each read more than once by the next, so the optimizer computes them once a row: the text; its words, its lines, what is
    left without letters (short), its capitals; then counts."""
    kept = [f"__k{i}" for i in range(len(keep))]
    t, size = F.col("__t"), lambda c: F.char_length(c).cast("double")
    x = docs.select(*[c.alias(k) for c, k in zip(keep, kept, strict=True)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    x = x.select(
        *kept, size(t).alias("__n"), F.split(t, r"\s+").alias("__w"), F.split(t, "\n").alias("__l"),
        F.regexp_replace(t, r"\p{L}++", "").alias("__rest"), size(F.regexp_replace(t, r"\P{Lu}++", "")).alias("__upper"),
    )
    w, lines, rest = F.col("__w"), F.col("__l"), F.col("__rest")
    only = lambda others: size(F.regexp_replace(rest, others, ""))
    x = x.select(
        *kept, "__upper", F.greatest("__n", F.lit(1.0)).alias("n"), (F.col("__n") - size(rest)).alias("letters"),
        F.greatest(F.size(w) - (F.get(w, F.lit(0)) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int"), F.lit(1)).cast("double").alias("words"),
        F.size(F.filter(w, lambda a, i: a == F.get(w, i + 1))).cast("double").alias("again"), F.size(F.array_distinct(w)).cast("double").alias("distinct"),
        F.size(lines).cast("double").alias("lines"), F.size(F.array_distinct(lines)).cast("double").alias("distinct_lines"),
        only(r"\P{Nd}++").alias("digits"), only(r"[^|]++").alias("bars"), only(r"[^!?]++").alias("shouts"), only(r"[^.,;:]++").alias("stops"), only(r"[\p{N}\p{M}\s.,;:!?'\"()|-]++").alias("symbols"),
    )
    c = F.col
    found = {
        "log_chars": F.log("n"),
        "chars_per_word": c("n") / c("words"),
        "letter_share": c("letters") / c("n"),
        "upper_share": c("__upper") / F.greatest("letters", F.lit(1.0)),
        "digit_share": c("digits") / c("n"),
        "symbols_per_word": c("symbols") / c("words"),
        "bars_per_word": c("bars") / c("words"),
        "shouts_per_word": c("shouts") / c("words"),
        "stops_per_word": c("stops") / c("words"),
        "repeated_word_share": c("again") / c("words"),
        "distinct_word_share": c("distinct") / c("words"),
        "repeated_line_share": 1 - c("distinct_lines") / c("lines"),
        "words_per_line": c("words") / c("lines"),
    }
    return x.select(*[F.col(k).alias(name) for k, name in zip(kept, docs.select(*keep).columns, strict=True)], F.array(*[found[name] for name in STATISTICS]).alias(out))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, threshold): the statistic is over the threshold if above, else at most the threshold."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: tuple[str, ...] = STATISTICS) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, at in self.terms:
            v = x[:, names.index(name)]
            out &= v > at if above else v <= at
        return out

    def column(self, of) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            out = out & (of(name) > at if above else of(name) <= at)
        return out


@dataclass
class RuleEnsemble:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, of) -> Column:
        z = F.lit(float(self.bias))
        for rule, w in self.rules:
            z = z + F.when(rule.column(of), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, cuts: list[np.ndarray], r: np.ndarray, rows: np.ndarray, terms: dict, depth: int, fewest: int) -> list[tuple[np.ndarray, dict]]:
    """The nodes below a node, each with its rows and its terms {(statistic, above): threshold}; a later cut of the same side replaces an earlier one, as it is the tighter."""
    best = (1e-9, None, None)
    total, n = r[rows].sum(), len(rows)
    for j, at in enumerate(cuts):
        if not len(at):
            continue
        place = np.searchsorted(at, x[rows, j])  # value <= at[k] for place <= k
        sums = np.cumsum(np.bincount(place, r[rows], len(at) + 1))[:-1]
        many = np.cumsum(np.bincount(place, minlength=len(at) + 1))[:-1]
        ok = (many >= fewest) & (n - many >= fewest)
        if ok.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, sums**2 / many + (total - sums) ** 2 / (n - many) - total**2 / n, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(at[k]))
    _, j, at = best
    if j is None:
        return []
    out = []
    low = x[rows, j] <= at
    for above, part in ((False, rows[low]), (True, rows[~low])):
        t = terms | {(j, above): at}
        out.append((part, t))
        if depth > 1:
            out += _grow(x, cuts, r, part, t, depth - 1, fewest)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS, trees: int = TREES, depth: int = DEPTH, seed: int = 0) -> list[Rule]:
    """The paths of boosted trees; of rules that hold for the same rows the first stays."""
    rng = np.random.default_rng(seed)
    fewest = max(2, int(LEAST * len(x)))
    cuts = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        middle = (v[1:] + v[:-1]) / 2
        cuts.append(middle if len(middle) <= BINS else np.unique(np.quantile(middle, np.arange(1, BINS + 1) / (BINS + 1))))
    z = np.full(len(x), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    found: dict[bytes, Rule] = {}
    for _ in range(trees):
        r = y - 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(x)) < SHARE)
        some = [c if rng.random() < 0.7 else c[:0] for c in cuts]
        nodes = _grow(x, some, r, rows, {}, depth, fewest)
        for _, terms in nodes:
            rule = Rule(tuple((names[j], above, at) for (j, above), at in sorted(terms.items())))
            holds = rule.holds(x, names)
            if LEAST <= holds.mean() <= 1 - LEAST:
                found.setdefault(np.packbits(holds).tobytes(), rule)
        # The tree's own step: each leaf moves by a Newton step.
        leaves = [(rows_, terms) for rows_, terms in nodes if not any(set(terms) < set(o) and all(o[k] == v for k, v in terms.items()) for _, o in nodes)]
        for _, terms in leaves:
            rule = Rule(tuple((names[j], above, at) for (j, above), at in terms.items()))
            holds = rule.holds(x, names)
            p = 1 / (1 + np.exp(-z[holds]))
            z[holds] += SHRINK * float(np.clip((y[holds] - p).sum() / max(1e-3, (p * (1 - p)).sum()), -4, 4))
    return list(found.values())


def lasso(h: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic model with an L1 penalty on the weights, by accelerated proximal steps."""
    n, m = h.shape
    a = np.concatenate([np.ones((n, 1)), h], axis=1)
    v = np.ones(m + 1)
    for _ in range(30):  # the largest singular value bounds the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1
    step = 4 * n / (np.linalg.norm(a @ v) ** 2 * 1.02 + 1e-9)
    w, u, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(rounds):
        new = u - step * (a.T @ (1 / (1 + np.exp(-np.clip(a @ u, -40, 40))) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS) -> RuleEnsemble:
    """The strongest penalty whose log loss on a fifth of these rows is within a hundredth of the best, then the same on all rows.
    Rows of one label only, or none, give a constant: their share, drawn towards one half."""
    y = np.asarray(y, float)
    x = np.asarray(x, float).reshape(len(y), len(names))
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(float(np.log(share / (1 - share))))
    rules = tree_rules(x, y, names)
    if not rules:
        return RuleEnsemble(float(np.log(share / (1 - share))))
    h = np.stack([r.holds(x, names) for r in rules], axis=1).astype(float)
    check = np.arange(len(y)) % 5 == 0
    losses = []
    for penalty in PENALTIES:
        b, w = lasso(h[~check], y[~check], penalty)
        z = np.clip(b + h[check] @ w, -30, 30)
        losses.append(float(np.mean(np.log1p(np.exp(z)) - y[check] * z)))
    chosen = next(p for p, v in zip(PENALTIES, losses, strict=True) if v <= min(losses) + 0.01)
    b, w = lasso(h, y, chosen)
    return RuleEnsemble(b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def fit_labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int | None = 2, max_docs: int = MAX_FIT_DOCS) -> RuleEnsemble:
    """Learns from labelled documents whose id's crc32 has another remainder by 4 than held_out. At most max_docs labelled ids,
    chosen by a hash of the id, and as many rows of statistics come to the driver, however many labels there are. Null ids and labels
    are left out; of several labels of one id the largest counts."""
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1))
    if held_out is not None:
        marks = marks.where(id_crc("__id") % 4 != held_out)
    chosen = marks.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")  # at most max_docs ids
    rows = with_statistics(rows, "__text", [F.col("__id"), F.col("__y")], "__x").orderBy(F.xxhash64("__id"), "__id", "__x").limit(max_docs).collect()
    return fit(np.array([r["__x"] for r in rows]), [r["__y"] for r in rows])


def score_quality(docs: DataFrame, model: RuleEnsemble, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text. Null and empty texts have the statistics of no characters; null and
    repeated ids are rows like any other; no rows give no rows. Other columns are not read.

    The statistics are one array column, computed once a row; the rules read its places."""
    rows = with_statistics(docs, text_col, [F.col(id_col).alias("doc_id")], "__x")
    return rows.select("doc_id", model.column(lambda name: F.col("__x")[STATISTICS.index(name)]).alias("score"))
