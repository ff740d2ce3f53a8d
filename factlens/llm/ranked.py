"""Operator 11: ranked lexical search over an index that recursive graph bisection has reordered and cut into clusters.

Bisection halves a set of documents again and again so that documents with common terms come to the same half: each starts on a side,
each term costs d * log2(n / (d + 1)) on a side of n documents of which d hold it, and the documents whose moves save most are
exchanged in pairs while a pair saves anything.

1. A tree of halvings is fit on a bounded sample (FIT_DOCS documents, FIT_TERMS terms). Every document goes down the tree to the side where its terms cost
   less, in a scan, so like documents of the whole corpus meet in one leaf. Leaves are cut into shards of about SHARD documents.
2. Each shard is bisected down to clusters of CLUSTER documents. Its postings stand in that order, with the largest impact of each term in each cluster
   and in the shard.
3. An item's bound for a shard or cluster is the sum of its terms' largest impacts there. Each item visits its best shard first. The tenth score found
   there is the score to beat: other shards are visited only if their bound reaches it, and inside a shard clusters are visited by falling bound until
   one is below the tenth score so far. Bounds that equal it are visited, as a smaller doc_id may win the tie. So the result is exact.

Items come in batches of ITEMS; an index holds the terms that its batch asks for (postings of other terms are never read). What a
batch brings to the driver is bounded by its items: their terms, weights and scores to beat.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.splits import numbered
from .common import importable, new_path, written

ITEMS, FIT_DOCS, FIT_TERMS, LEAF_DEPTH, SHARD, CLUSTER, ROUNDS = 1000, 4096, 4096, 5, 2048, 32, 8
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: A byte of a term as it is (A-Z in lower case), any other as a blank. Bytes from 128 on are parts of letters beyond ASCII.
_TERM_BYTES = bytes(b if b >= 128 or b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Stands for a null id: it comes after all others in a tie.
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def bisect(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, depth: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of the 2^depth parts, in order, each document goes to; and for each level, by part and term, what a document with that
    term saves by the second half. doc, term: the postings."""
    part = np.zeros(n_docs, np.int64)
    place = np.arange(n_docs)
    levels = []
    for level in range(depth):
        parts = 1 << level
        sizes = np.bincount(part, minlength=parts)
        order = np.lexsort((place, part))
        nth = np.arange(n_docs) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        side = np.empty(n_docs, np.int64)
        side[order] = nth >= (np.repeat(sizes, sizes) + 1) // 2
        for step in range(rounds + 1):
            half = 2 * part + side
            n = np.bincount(half, minlength=2 * parts).astype(float)
            d = np.bincount(half[doc] * n_terms + term, minlength=2 * parts * n_terms).reshape(2 * parts, n_terms).astype(float)
            if step == rounds:
                break
            size = np.maximum(n, 1)[:, None]
            cost = lambda x, size=size: x * np.log2(size / (x + 1))
            lose, get = cost(d) - cost(np.maximum(d - 1, 0)), cost(d) - cost(d + 1)
            gain = lose + get.reshape(parts, 2, n_terms)[:, ::-1].reshape(2 * parts, n_terms)
            gain = np.bincount(doc, gain[half[doc], term], n_docs)
            by = np.lexsort((-gain, half))
            count = n.astype(np.int64)
            start = np.cumsum(count) - count
            rank = np.arange(n_docs) - np.repeat(start, count)
            other = half[by] ^ 1
            paired = rank < count[other]
            swap = np.zeros(n_docs, bool)
            swap[paired] = gain[by[paired]] + gain[by[start[other[paired]] + rank[paired]]] > 1e-9
            if not swap.any():
                break
            side[by[swap]] ^= 1
        size = np.maximum(n, 1)[:, None]
        at = np.log2(size / (d + 1))
        levels.append((at[0::2] - at[1::2]).astype(np.float32))
        part = 2 * part + side
    return part, levels


@dataclass
class Tree:
    """column: of each of the vocabulary's terms, its place in the levels' tables, or -1."""

    column: np.ndarray
    levels: list[np.ndarray]

    def leaves(self, doc: np.ndarray, term: np.ndarray, n_docs: int) -> np.ndarray:
        at = self.column[term]
        doc, at = doc[at >= 0], at[at >= 0]
        leaf = np.zeros(n_docs, np.int64)
        for saves in self.levels:
            leaf = 2 * leaf + (np.bincount(doc, saves[leaf[doc], at], n_docs) > 0)
        return leaf


def fit_tree(terms: list[np.ndarray], n_terms: int, depth: int = LEAF_DEPTH, fit_terms: int = FIT_TERMS) -> Tree:
    """From the sample's documents. Terms of one document or of nearly all tell nothing; of the rest the most frequent count."""
    flat = np.concatenate(terms) if terms else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    df = np.bincount(flat, minlength=n_terms)
    useful = np.flatnonzero((df >= 2) & (df <= 0.9 * len(terms)))
    useful = useful[np.argsort(-df[useful], kind="stable")][:fit_terms]
    column = np.full(n_terms, -1)
    column[useful] = np.arange(len(useful))
    depth = min(depth, max(0, int(math.log2(max(1, len(terms)) / 8))))
    keep = column[flat] >= 0
    return Tree(column, bisect(doc[keep], column[flat][keep], len(terms), max(1, len(useful)), depth)[1] if keep.any() else [])


def _reader(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = vocabulary.get
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = terms_of(text)
                counts = Counter(i for i in map(find, words) if i is not None)
                terms = np.array(sorted(counts), np.int32)
                out.append((doc_id, len(words), terms, np.array([counts[t] for t in terms.tolist()], np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "tfs"])

    return run


def _router(tree: Tree):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                flat = np.concatenate(batch["terms"].to_list()).astype(np.int64)
                doc = np.repeat(np.arange(len(batch)), batch["terms"].map(len))
                batch["leaf"] = tree.leaves(doc, flat, len(batch))
                yield batch

    return run


def _norms(n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """m of the contract; whole numbers of any size."""
    if 75 * int(n.max()) * n_docs < 1 << 62:
        return 25 + 75 * n.astype(np.int64) * n_docs // n_all
    return np.array([25 + 75 * int(v) * n_docs // n_all for v in n], np.int64)


def _builder(n_docs: int, n_all: int, cluster: int):
    """A shard's rows as one row of the index."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)  # the same whatever order they arrive in
        lengths = rows["terms"].map(len).to_numpy()
        term = np.concatenate(rows["terms"].to_list()).astype(np.int64)
        tf = np.concatenate(rows["tfs"].to_list()).astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), lengths)
        known, at = np.unique(term, return_inverse=True)
        depth = max(0, math.ceil(math.log2(len(rows) / cluster)))
        df = np.bincount(at)
        column = np.cumsum(df >= 2) - 1
        tells = df[at] >= 2
        part = bisect(doc[tells], column[at[tells]], len(rows), int((df >= 2).sum()), depth)[0] if depth and tells.any() else np.zeros(len(rows), np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * _norms(rows["n"].to_numpy(), n_docs, n_all)[doc])
        by = np.lexsort((place[doc], at))
        places, impacts, at = place[doc][by], impact[by], at[by]
        entry = at * (len(rows) // cluster + 1) + places // cluster
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        tops = np.maximum.reduceat(impacts, first)
        starts = np.searchsorted(at[first], np.arange(len(known) + 1))
        ids = rows["doc_id"].to_numpy()[order]
        return pd.DataFrame({
            "shard": [rows["shard"].iloc[0]], "ids": [ids], "terms": [known], "best": [np.maximum.reduceat(tops, starts[:-1])],
            "starts": [starts], "clusters": [places[first] // cluster], "tops": [tops], "firsts": [np.append(first, len(places))], "places": [places], "impacts": [impacts],
        })

    return run


_INDEX = "shard long, ids array<long>, terms array<int>, best array<int>, starts array<int>, clusters array<int>, tops array<int>, firsts array<int>, places array<int>, impacts array<int>"


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0] - 1, lo[1] .. and so on."""
    n = hi - lo
    return np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


@dataclass
class Item:
    """terms: places in the vocabulary, ascending; weights: of all their occurrences."""

    number: int
    terms: np.ndarray
    weights: np.ndarray

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the item's terms among a shard's, and their weights."""
        at = np.searchsorted(terms, self.terms)
        at[at == len(terms)] = 0
        ok = terms[at] == self.terms
        return at[ok], self.weights[ok]


def visit(shard, item: Item, beat: int, k: int) -> tuple[list[tuple[int, int]], int]:
    """The shard's k best (score, id) of those that reach beat, and how many clusters were visited."""
    at, w = item.found(shard.terms)
    lo, hi = shard.starts[at], shard.starts[at + 1]
    entries, weights = _ranges(lo, hi), np.repeat(w, hi - lo)
    bounds = np.zeros(int(shard.clusters.max()) + 1, np.int64)
    np.add.at(bounds, shard.clusters[entries], weights * shard.tops[entries])
    order = np.argsort(-bounds, kind="stable")
    score, best, done, size = np.zeros(len(shard.ids), np.int64), [], 0, 1
    while done < len(order):
        wave = order[done : done + size]
        wave = wave[(bounds[wave] >= max(beat, 1))]
        if not len(wave):
            break
        inside = np.zeros(len(bounds), bool)
        inside[wave] = True
        of = inside[shard.clusters[entries]]
        e = entries[of]
        lo, hi = shard.firsts[e], shard.firsts[e + 1]
        p = _ranges(lo, hi)
        places = shard.places[p]
        np.add.at(score, places, np.repeat(weights[of], hi - lo) * shard.impacts[p])
        hit = np.unique(places)
        hit = hit[score[hit] >= max(beat, 1)]
        best = sorted(best + [(-int(score[i]), int(shard.ids[i])) for i in hit])[:k]
        if len(best) == k:
            beat = max(beat, -best[-1][0])
        done += len(wave)
        size *= 4
    return best, done


class _Shard:
    def __init__(self, row):
        for name in ("ids", "terms", "best", "starts", "clusters", "tops", "firsts", "places", "impacts"):
            setattr(self, name, np.asarray(getattr(row, name), np.int64))


def _bounder(items: list[Item]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard, terms, best in zip(batch["shard"], batch["terms"], batch["best"], strict=True):
                terms, best = np.asarray(terms, np.int64), np.asarray(best, np.int64)
                for item in items:
                    at, w = item.found(terms)
                    bound = int((best[at] * w).sum())
                    if bound > 0:
                        out.append((item.number, shard, bound))
            yield pd.DataFrame(out, columns=["item", "shard", "bound"])

    return run


def _visitor(items: list[Item], beat: dict[int, int], k: int):
    by = {i.number: i for i in items}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                shard = _Shard(row)
                for number in row.items:
                    found, _ = visit(shard, by[number], beat.get(number, 1), k)
                    out += [(number, -s, i) for s, i in found]
            yield pd.DataFrame(out, columns=["item", "score", "id"])

    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table of shards; small row groups, so that a task reads few of them at once."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], shard: int = SHARD, cluster: int = CLUSTER) -> tuple[DataFrame, int, int, dict[int, int]]:
    """The index of docs (doc_id, text) over these terms; how many documents have terms, how many terms these have, and of each term of the vocabulary how many documents hold it."""
    read = written(docs.mapInPandas(_reader(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>").withColumn("row", F.monotonically_increasing_id()), "ranked-terms")
    n_docs, n_all = read.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["many"] for r in read.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("many")).collect()}  # a row a term of the vocabulary
    rows = read.where(F.size("terms") > 0)
    sample = [np.asarray(r["terms"]) for r in rows.select("row", "terms").orderBy(F.xxhash64("row"), "row").limit(FIT_DOCS).select("terms").collect()]
    tree = fit_tree(sample, len(vocabulary))
    placed = written(rows.mapInPandas(_router(tree), "doc_id long, n long, terms array<int>, tfs array<int>, row long, leaf long"), "ranked-leaves")
    cuts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / shard).alias("cuts"))  # 2^LEAF_DEPTH rows at most
    shards = placed.join(F.broadcast(cuts), "leaf").withColumn("shard", F.col("leaf") * F.lit(1 << 40) + F.pmod(F.xxhash64("row"), F.col("cuts")))
    index = shards.select("shard", "doc_id", "n", "terms", "tfs", "row").groupBy("shard").applyInPandas(_builder(n_docs, n_all, cluster), _INDEX)
    return _stored(index, "ranked-index"), n_docs, n_all, df


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", batch: int = ITEMS, shard: int = SHARD, cluster: int = CLUSTER) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents with the highest score over 0 for each row of items, all if fewer; equal scores by doc_id, null last.

    doc_id is a whole number. Null texts have no terms. Rows that share an id are documents of their own, and so are rows of items that share theirs. Items
    without a known term, an empty table of items or of documents give no rows. Whole texts count, of any length. Other columns are not read.
    """
    spark = docs.sparkSession
    importable(spark)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NO_ID))).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    asked = written(numbered(asked.withColumn("__tie", F.xxhash64("text")), ["item_id", "__tie"], "item").drop("__tie"), "ranked-items")
    many = asked.count()
    out = None
    for at in range(0, max(1, many), batch):
        part = asked.where((F.col("item") >= at) & (F.col("item") < at + batch))
        wanted = {r["item"]: Counter(terms_of(r["text"])) for r in part.collect()}  # at most `batch` rows
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
        found = _rank(texts, vocabulary, wanted, k, shard, cluster)
        found = found.join(F.broadcast(part.select("item", "item_id")), "item")  # at most `batch` rows
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "id"))
    ranked = out.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.when(F.col("id") != int(_NO_ID), F.col("id")).alias("doc_id"), "score")


def _rank(texts: DataFrame, vocabulary: dict[bytes, int], wanted: dict[int, Counter], k: int, shard: int, cluster: int) -> DataFrame:
    """item, score, id: of every visited shard the documents that can be among the k best."""
    kind = "item long, score long, id long"
    index, n_docs, _, df = build_index(texts, vocabulary, shard, cluster)
    items = []
    for number, counts in wanted.items():
        terms = np.array(sorted(vocabulary[t] for t in counts if vocabulary[t] in df), np.int64)
        of = {vocabulary[t]: c for t, c in counts.items()}
        weights = [of[t] * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms.tolist()]
        if any(weights):
            items.append(Item(number, terms, np.array(weights, np.int64)))
    spark = texts.sparkSession
    if not items:
        return spark.createDataFrame([], kind)
    pairs = written(index.select("shard", "terms", "best").mapInPandas(_bounder(items), "item long, shard long, bound long"), "ranked-bounds")
    first = pairs.groupBy("item").agg(F.max_by("shard", "bound").alias("shard"))  # a row an item
    visits = lambda p: index.join(p.groupBy("shard").agg(F.collect_list("item").alias("items")), "shard")
    first = written(first, "ranked-first")
    begun = written(visits(first).mapInPandas(_visitor(items, {}, k), kind), "ranked-begun")
    beat = {r["item"]: r["score"] for r in begun.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).collect()}  # a row an item
    to_beat = spark.createDataFrame(list(beat.items()), "item long, beat long")
    rest = pairs.join(F.broadcast(first.select("item", F.col("shard").alias("seen"))), "item").join(F.broadcast(to_beat), "item", "left").where("shard <> seen AND bound >= coalesce(beat, 1)")
    return begun.unionByName(visits(rest.select("item", "shard")).mapInPandas(_visitor(items, beat, k), kind))
