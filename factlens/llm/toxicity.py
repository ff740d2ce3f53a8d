"""Operator 2: a linear-chain conditional random field over words, two states (plain, toxic).

Fit on a bounded sample of labelled documents: at most MAX_FIT_DOCS rows and MAX_FIT_CHARS characters, taken in the order of
a hash of the id, whole documents only, none of over a hundredth of these characters. A document label marks tokens: a word of a toxic document is a toxic token when
MIN_SHARE of the toxic documents (MIN_GROUPS at least) have it, or words that begin like it (STEMS letters), and clean ones
far more rarely, with no more than CHANCE such words to be expected at random; exact and near copies count once, else the words of a much-copied text would pass for toxic. The field's weights (words, word beginnings, transitions) are fit to
these tokens by gradient ascent on the conditional log-likelihood, and a logistic curve over the totals of the marginals of
FLOOR or more is fit to the document labels.

Scoring runs where the rows are: forward-backward marginals over every word of every text, exact, in blocks of words that
are vectorised over all documents of a batch. Nothing but words enters a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, importable

MAX_FIT_DOCS, MAX_FIT_CHARS = 3000, 15_000_000
STEMS = (4, 5, 6)
MIN_SHARE, MIN_GROUPS, MIN_RATIO, CHANCE = 0.02, 3, 20.0, 3.0
STEPS, RATE, L2 = 25, 0.7, 1e-4
SPAN_AT, FLOOR = 0.5, 0.01
BLOCK = 64
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # log-odds of a toxic token, by word and, after a "^", by word beginning
    bias: float = -8.0
    transitions: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # from plain: to plain, toxic; from toxic: to plain, toxic
    curve: tuple[float, float, float] = (-6.0, 0.0, 0.0)  # of 1, log1p(expected toxic words), log1p(those in a thousand)

    known: dict | None = field(default=None, repr=False, compare=False)

    def emission(self, words: list[str]) -> np.ndarray:
        if self.known is None:
            self.known = _Known(self.bias, self.weights)
        known = self.known
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))


class _Known(dict):
    """Emissions by word, for words as they come."""

    def __init__(self, bias: float, weights: dict[str, float], keep: int = 150_000):
        super().__init__()
        self.bias, self.weights, self.keep = bias, weights, keep

    def __missing__(self, key: str) -> float:
        if len(self) >= self.keep:
            self.clear()
        get = self.weights.get
        self[key] = v = self.bias + sum(get(f, 0.0) for f in _traits(key))
        return v


def _traits(word: str) -> list[str]:
    """What a word is scored by: itself and its beginnings."""
    return [word, *("^" + word[:n] for n in STEMS if len(word) >= n)]


def _groups(docs: list[list[str]]) -> list[int]:
    """A number for each document, the same for exact and near copies: documents that share a pair of smallest five-word hashes."""
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict[tuple, int] = {}
    salts = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
    for i, words in enumerate(docs):
        h = np.array([zlib.crc32(" ".join(words[j : j + 5]).encode()) for j in range(max(1, len(words) - 4))], np.uint64)
        low = [int((h * s >> np.uint64(20)).min()) for s in salts]
        for band in range(0, 8, 2):
            root[find(i)] = find(first.setdefault((band, low[band], low[band + 1]), i))
    return [find(i) for i in range(len(docs))]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def marginals(emission: np.ndarray, lengths: np.ndarray, transitions: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every word of the documents that lie one after another, and P(toxic, toxic) with the word before.

    Documents are cut into blocks of BLOCK words. The product of each block's 2x2 matrices takes a message over the block, so
    a loop over blocks (the longest document's) gives the messages at the cuts, and a loop over BLOCK places those inside.
    """
    n_docs, total = len(lengths), int(lengths.sum())
    if not total:
        return np.empty(0), np.empty(0)
    t = np.exp(np.array(transitions).reshape(2, 2))
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(first[-1])
    doc_at = np.concatenate([[0], np.cumsum(lengths)])
    doc_of = np.repeat(np.arange(n_docs), lengths)
    inner = np.arange(total) - doc_at[doc_of]
    row, col = first[doc_of] + inner // BLOCK, inner % BLOCK
    e = np.zeros((BLOCK, nb))
    e[col, row] = np.clip(emission, -30, 30)
    used = np.zeros((BLOCK, nb), bool)
    used[col, row] = True
    e = np.exp(e)  # weight of toxic; plain weighs 1
    # Products of the matrices M = T diag(1, e); a place past the end is the identity.
    p00, p01, p10, p11 = np.ones(nb), np.zeros(nb), np.zeros(nb), np.ones(nb)
    for i in range(BLOCK):
        u, x = used[i], e[i]
        a, b = p00 * t[0, 0] + p01 * t[1, 0], (p00 * t[0, 1] + p01 * t[1, 1]) * x
        c, d = p10 * t[0, 0] + p11 * t[1, 0], (p10 * t[0, 1] + p11 * t[1, 1]) * x
        s = np.maximum(np.maximum(a, b), np.maximum(c, d))
        p00, p01, p10, p11 = np.where(u, a / s, p00), np.where(u, b / s, p01), np.where(u, c / s, p10), np.where(u, d / s, p11)
    enter, leave = np.full(nb, 0.5), np.full(nb, 0.5)  # share of toxic in the forward message before a block, the backward one after it
    start, stop = first[:-1], first[1:]
    most = int(blocks.max())
    f0 = np.full(n_docs, 1.0)
    f1 = np.full(n_docs, 1.0)
    order = np.argsort(-blocks, kind="stable")
    n_with = np.searchsorted(-blocks[order], -np.arange(1, most + 1), side="right")
    for k in range(most):
        d = order[: n_with[k]]
        b = start[d] + k
        s = f0[d] + f1[d]
        enter[b] = f1[d] / s
        x0, x1 = f0[d] / s, f1[d] / s
        f0[d], f1[d] = x0 * p00[b] + x1 * p10[b], x0 * p01[b] + x1 * p11[b]
    g0, g1 = np.ones(n_docs), np.ones(n_docs)
    for k in range(most):
        d = order[: n_with[k]]
        b = stop[d] - 1 - k
        s = g0[d] + g1[d]
        leave[b] = g1[d] / s
        y0, y1 = g0[d] / s, g1[d] / s
        g0[d], g1[d] = p00[b] * y0 + p01[b] * y1, p10[b] * y0 + p11[b] * y1
    fwd = np.empty((BLOCK, nb))
    a1 = enter.copy()
    for i in range(BLOCK):
        a0 = 1 - a1
        z0, z1 = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * e[i]
        a1 = np.where(used[i], z1 / (z0 + z1), a1)
        fwd[i] = a1
    p, pair = np.empty((BLOCK, nb)), np.empty((BLOCK, nb))
    b1 = leave
    for i in range(BLOCK - 1, -1, -1):
        u, b0 = used[i], 1 - b1
        q = fwd[i] * b1 / (fwd[i] * b1 + (1 - fwd[i]) * b0)
        p[i] = q
        prev = fwd[i - 1] if i else enter
        w1 = b1 * e[i]
        j00, j01, j10, j11 = (1 - prev) * t[0, 0] * b0, (1 - prev) * t[0, 1] * w1, prev * t[1, 0] * b0, prev * t[1, 1] * w1
        pair[i] = j11 / (j00 + j01 + j10 + j11)
        y0, y1 = t[0, 0] * b0 + t[0, 1] * w1, t[1, 0] * b0 + t[1, 1] * w1
        b1 = np.where(u, y1 / (y0 + y1), b1)
    return p[col, row], pair[col, row]


def _features(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum(lengths)])
    run = np.concatenate([[0.0], np.cumsum(np.where(p >= FLOOR, p, 0.0))])  # else a very long text's many small chances would add up
    toxic = np.maximum(run[at[1:]] - run[at[:-1]], 0)
    return np.stack([np.ones(len(lengths)), np.log1p(toxic), np.log1p(1000 * toxic / np.maximum(lengths, 1))], axis=1)


def scores(model: Model, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(p, lengths) @ np.array(model.curve), -40, 40)))


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """Without two classes of labels the model scores every text alike: near 0."""
    y = np.array(toxic, dtype=int)
    if not len(y) or y.min() == y.max():
        return Model()
    one: dict[str, str] = {}
    docs = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]  # a string a word, not one a token
    seen, met, size = [Counter(), Counter()], set(), [0, 0]
    for words, label, group in zip(docs, y, _groups(docs), strict=True):
        if (group, label) not in met:
            met.add((group, label))
            size[label] += 1
            seen[label].update({f for w in set(words) for f in _traits(w)})
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    rate, kept_by = size[1] / (size[0] + size[1]), Counter((seen[0] + seen[1]).values())
    at_least, run = {}, 0
    for t in sorted(kept_by, reverse=True):
        run += kept_by[t]
        at_least[t] = run

    def by_chance(k: int, t: int) -> float:
        """How many traits that t documents have would show k toxic ones or more, if all fell at random."""
        return at_least.get(t, run) * sum(math.comb(t, j) * rate**j * (1 - rate) ** (t - j) for j in range(k, t + 1)) if t < 60 else 0.0

    least = max(min(MIN_GROUPS, size[1]), MIN_SHARE * size[1])
    marked = {w for w, k in seen[1].items() if k >= least and ((k + 0.5) / (size[1] + 1)) / ((seen[0][w] + 0.5) / (size[0] + 1)) >= min(MIN_RATIO, size[0] / 2) and by_chance(k, k + seen[0][w]) <= CHANCE}
    every = seen[0] + seen[1]
    vocabulary = sorted({w for w, k in every.items() if k >= 3} | marked)
    column = {w: i for i, w in enumerate(vocabulary)}
    none = len(vocabulary)  # for what the vocabulary lacks; its weight stays 0
    lengths = np.array([len(d) for d in docs])
    kinds = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    of_kind = np.full((len(kinds), 1 + len(STEMS)), none, dtype=np.int64)
    bad = np.zeros(len(kinds))
    for w, i in kinds.items():
        own = _traits(w)
        of_kind[i, : len(own)] = [column.get(f, none) for f in own]
        bad[i] = any(f in marked for f in own)
    ids = np.array([kinds[w] for d in docs for w in d], dtype=np.int64)
    gold = bad[ids] * np.repeat(y, lengths)
    if not gold.sum():
        return Model()
    start = np.zeros(len(ids), bool)
    start[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    before = np.concatenate([[0.0], gold[:-1]]) * ~start
    w, tr = np.zeros(none + 1), np.zeros(4)
    bias, sq_w, sq_t, sq_b = -4.0, np.full(len(w), 1e-8), np.full(4, 1e-8), 1e-8
    inside = ~start
    first_gold = np.where(inside, before, 0)
    t11 = float((first_gold * gold)[inside].sum())
    t10 = float((first_gold * (1 - gold))[inside].sum())
    t01 = float(((1 - first_gold) * gold)[inside].sum())
    true_t = np.array([inside.sum() - t11 - t10 - t01, t01, t10, t11])
    scale = 1.0 / max(gold.sum(), 1.0)
    for _ in range(STEPS):
        p, pair = marginals((bias + w[of_kind].sum(axis=1))[ids], lengths, tuple(tr))
        prev = np.concatenate([[0.0], p[:-1]])
        e11 = float(pair[inside].sum())
        e10, e01 = float(prev[inside].sum()) - e11, float(p[inside].sum()) - e11
        gt = (true_t - np.array([inside.sum() - e11 - e10 - e01, e01, e10, e11])) * scale
        miss = np.bincount(ids, gold - p, len(kinds))
        gw = sum(np.bincount(c, miss, none + 1) for c in of_kind.T) * scale - L2 * w
        gw[none] = 0
        gb = float((gold - p).sum()) * scale
        sq_w += gw * gw
        sq_t += gt * gt
        sq_b += gb * gb
        w += RATE * gw / np.sqrt(sq_w)
        tr += RATE * gt / np.sqrt(sq_t)
        bias += RATE * gb / np.sqrt(sq_b)
    model = Model({v: float(x) for v, x in zip(vocabulary, w, strict=False) if abs(x) > 0.05}, float(bias), tuple(float(v) for v in tr))
    p, _ = marginals((bias + w[of_kind].sum(axis=1))[ids], lengths, model.transitions)
    x, c = _features(p, lengths), np.array([-2.0, 1.0, 0.0])
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    sq = np.full(3, 1e-8)
    for _ in range(3000):
        g = x.T @ (weight * (y - 1 / (1 + np.exp(-np.clip(x @ c, -40, 40))))) - 1e-4 * c
        sq += g * g
        c += 0.3 * g / np.sqrt(sq)
    model.curve = tuple(float(v) for v in c)
    return model


def fit_labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int | None = 1, max_docs: int = MAX_FIT_DOCS, max_chars: int = MAX_FIT_CHARS) -> Model:
    """Learns from labelled documents whose id's crc32 has another remainder by 3 than held_out. At most max_docs rows and max_chars characters come to the driver: ids and lengths decide first, and only the texts chosen are read for it."""
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1))
    if held_out is not None:
        marks = marks.where(id_crc("__id") % 3 != held_out)
    chosen = marks.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = docs.select(F.col(id_col).alias("__id"), F.char_length(text).alias("__n")).where(F.col("__n") <= max_chars // 100).join(F.broadcast(chosen), "__id")  # at most max_docs ids
    order = [F.xxhash64("__id"), F.col("__id"), F.col("__n")]
    sizes = sizes.orderBy(*order).limit(max_docs)
    run = F.sum("__n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over at most max_docs rows
    picked = sizes.withColumn("__run", run).where(F.col("__run") <= max_chars).select("__id", "__y").distinct()
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).where(F.char_length("__text") <= max_chars // 100).join(F.broadcast(picked), "__id")
    got = rows.orderBy(F.xxhash64("__id"), "__id", F.char_length("__text")).limit(max_docs).collect()
    return fit([r["__text"] for r in got], [r["__y"] for r in got])


def _spans(text: str, hits: np.ndarray) -> list[dict]:
    """Where the words at hits stand in the text; neighbours with only blanks between join."""
    if len(text) != len(text.lower()):  # places are those of the text itself
        places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    else:
        places = [(m.start(), m.end()) for m in _WORD.finditer(text.lower())]
    out: list[dict] = []
    last = -2
    for i in hits.tolist():
        if i < len(places):
            a, b = places[i]
            if last == i - 1 and out and not text[out[-1]["stop"] : a].strip():
                out[-1]["stop"] = b
            else:
                out.append({"start": a, "stop": b})
            last = i
    return out


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("stop", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(0).to_pylist()]
                docs = [words_of(t) for t in texts]
                lengths = np.array([len(d) for d in docs], dtype=np.int64)
                p, _ = marginals(model.emission([w for d in docs for w in d]), lengths, model.transitions)
                ends = np.cumsum(lengths)
                hits = np.flatnonzero(p >= SPAN_AT)
                owner = np.searchsorted(ends, hits, side="right")
                spans: list[list[dict]] = [[] for _ in docs]
                for d in np.unique(owner):
                    spans[d] = _spans(texts[d], hits[owner == d] - (ends[d] - lengths[d]))
                cols = [pa.array(scores(model, p, lengths)), pa.array(spans, spans_type), *part.columns[1:]]
                yield pa.RecordBatch.from_arrays(cols, names=["score", "spans", *part.schema.names[1:]])

    return score


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | list[str] | None = None, score_col: str = "score", spans_col: str = "spans") -> DataFrame:
    """score, spans (start and stop, in code points, of the words whose marginal is SPAN_AT or more; neighbours join), and
    the columns of carry (doc_id if none are named).

    A null or empty text, or one without words, has the curve's score at no toxic words and no spans. Rows with a null or
    repeated id are scored like any other. Columns not named are not read. No rows give no rows.
    """
    importable(docs.sparkSession)
    named = [F.col(id_col).alias("doc_id")] if carry is None else [F.col(c) for c in carry]
    rows = docs.select(*named)
    inner = [f"c{i}" for i in range(len(rows.columns))]
    kinds = "".join(f", {i} {f.dataType.simpleString()}" for i, f in zip(inner, rows.schema.fields, strict=True))
    scored = docs.select(F.col(text_col).cast("string").alias("__text"), *[c.alias(i) for c, i in zip(named, inner, strict=True)])
    scored = scored.mapInArrow(_scorer(model), f"score double, spans array<struct<start:int,stop:int>>{kinds}")
    return scored.select(*[F.col(i).alias(c) for i, c in zip(inner, rows.columns, strict=True)], F.col("score").alias(score_col), F.col("spans").alias(spans_col))
