"""Operator 9: near-duplicate classes by Order MinHash, verified by banded alignment.

Words are white-space separated. Texts with the same words are one node, named by the smallest id (exact copies need no
alignment). A node's sketch: each of BANDS hash functions orders the occurrence-labelled k-mers (K words, and how often these
words came before); the PICK smallest are kept in text order, and every two of them, in that order, are a key, so moved
passages change it. Nodes that share a key are candidates. All pairs of a key's nodes that are of different classes are
tested or become of one class, whatever the size of the group:

1. each node is tested against the smallest node of all its keys, and against the one that is the smallest of most of its
   keys; this joins most of a large group at two tests a node;
2. the nodes of each key that has more than one class meet in one task with their word counts (in all, and in each of BAGS hash groups). A pair that
   meets more than once counts in the largest of its groups, so that a class forms once. What comes out is the nodes that have a pair which these counts leave;
3. these nodes meet again, with their texts: pairs are tested there, the likeliest first, but for those that links found there made one class. Only
   links come out. So no table holds the pairs of a group: rows and texts grow with its nodes.

Keys that more than CROWD nodes share (a licence, a site's template) say little, and their pairs would grow with the square of the crowd.
Their nodes meet by rare words instead: texts of n words that are similar have at least n - floor((1 - SIMILARITY) * n) words in common, a
word's second occurrence counting as another word. So in any one order of all words each has one of these among its first floor((1 - SIMILARITY) * n) + 1.
The order is by how many of the crowd's texts have a word, rarest first: the words of what a crowd shares come last and pair nothing. This loses
no link, in whatever order. Groups of more than SIDE nodes are compared in blocks, every block with every block, but for those of the group's
largest class among themselves: beside a large class of copies the few others cost no square.

So a link is missed only if its texts share no key. A pair is verified by alignment: edit similarity 1 - d / max(n, m) over
words of at least SIMILARITY. Word, pair and triple counts rule out what cannot reach it; k-mers that are unique in both texts
anchor a first alignment, whose gaps are counted exactly; if it exceeds the allowed edits, the whole pair is aligned: exactly, by bits where
that is the shorter way, else in a band that widens by one diagonal for each edit found, in time by the edits, not by the texts' product.

Classes are the connected components of verified links: smallest labels spread over links between classes. A key, a leader or
a class that holds a large share of all rows is dealt over several tasks in every join (common.dealt_join).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ONE_TASK, dealt_join, hot_keys, importable, written

K, BANDS, PICK, SIMILARITY = 5, 6, 5, 0.8
SMALL, CROWD, SIDE, BAGS, SLOTS, FEW_LINKS, AT_ONCE, MOST_KEYS, MOST_WORDS = 64, 1024, 1024, 256, 1 << 17, 1 << 16, 2048, 256, 1 << 21  # none changes a class
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


def kmer_hashes(h: np.ndarray, k: int = K) -> np.ndarray:
    """A text shorter than k words is one k-mer."""
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(len(h) if len(h) < k else k))
    for j in range(min(k, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def _labelled(g: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with the number of its earlier occurrences."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return _mix(g)
    at = np.flatnonzero(new)
    nth = np.arange(len(g)) - np.repeat(at, np.diff(np.concatenate([at, [len(g)]])))
    label = np.empty(len(g), np.uint64)
    label[order] = nth.astype(np.uint64)
    return _mix(g + label * np.uint64(0x9E3779B97F4A7C15))


def order_minhash(h: np.ndarray, bands: int = BANDS, pick: int = PICK, k: int = K) -> np.ndarray:
    """The keys, signed 64-bit numbers: at most pick * (pick - 1) / 2 for each band. A text of one k-mer has that as its key."""
    g = _labelled(kmer_hashes(h, k))
    n = len(g)
    if n == 1:
        return _mix(g + np.uint64(1)).view(np.int64)
    salts = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    if n <= pick:
        low = np.arange(n)[None, :]
    else:
        low = np.empty((bands, pick), np.int64)
        for i, s in enumerate(salts):
            x = (g ^ (s >> np.uint64(7))) * s
            x ^= x >> np.uint64(29)
            low[i] = np.argpartition(x, pick - 1)[:pick]
        low.sort(axis=1)  # in text order
    i, j = np.triu_indices(low.shape[1], 1)
    v = _mix(_mix(g[low[:, i]] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + g[low[:, j]])
    return np.unique(v).view(np.int64)


def _slide(a: np.ndarray, b: np.ndarray, i: np.ndarray, d: np.ndarray) -> None:
    """Moves each place (i, i + d) on over equal words, in place."""
    n, m = len(a), len(b)
    at = np.flatnonzero((i < n) & (i + d < m))
    for _ in range(6):
        if not len(at):
            return
        at = at[a[i[at]] == b[i[at] + d[at]]]
        i[at] += 1
        at = at[(i[at] < n) & (i[at] + d[at] < m)]
    for k in at.tolist():  # the few long runs, by growing stretches
        p, shift, step = int(i[k]), int(d[k]), 64
        while p < n and p + shift < m:
            w = min(step, n - p, m - p - shift)
            x = np.flatnonzero(a[p : p + w] != b[p + shift : p + shift + w])
            if len(x):
                p += int(x[0])
                break
            p, step = p + w, step * 4
        i[k] = p


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1.

    far[k] is the furthest place on diagonal k that e edits reach; with each edit the band grows by a diagonal on both sides,
    without those from which the end is out of reach.
    """
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    most_e = min(most, max(n, m))
    c = most_e + 1  # place of diagonal 0
    far = np.full(2 * most_e + 3, -(1 << 40), np.int64)
    low = high = 0
    for e in range(most_e + 1):
        if e:
            low, high = max(-e, -n, goal - (most_e - e)), min(e, m, goal + (most_e - e))
            if low > high:
                return most + 1
            x, y = c + low, c + high + 1
            d = np.arange(low, high + 1)
            i = np.maximum(np.maximum(far[x:y] + 1, far[x - 1 : y - 1]), far[x + 1 : y + 1] + 1)
            i = np.minimum(np.minimum(i, n), m - d)
        else:
            x, y, d, i = c, c + 1, np.zeros(1, np.int64), np.zeros(1, np.int64)
        _slide(a, b, i, d)
        far[x:y] = i
        if low <= goal <= high and far[c + goal] >= n:
            return e
    return most + 1


def _bitwise(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """As _banded, a column of the table at a time: the steps up and down in it are the bits of two numbers."""
    n, m = len(a), len(b)
    if not n or not m:
        return min(max(n, m), most + 1)
    places: dict = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    every, last = (1 << n) - 1, 1 << (n - 1)
    up, down, d = every, 0, n
    for left, w in zip(range(m - 1, -1, -1), b.tolist(), strict=True):
        same = places.get(w, 0)
        x = same | down
        y = ((same & up) + up ^ up) | same
        more, less = down | (every & ~(y | up)), up & y
        if more & last:
            d += 1
        elif less & last:
            d -= 1
        if d - left > most:
            return most + 1
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | (every & ~(x | more)), more & x
    return min(d, most + 1)


def _aligned(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """_banded or _bitwise, by the time that they take: about 45 us an edit, and 0.8 us a word and more for long texts."""
    return (_bitwise if len(b) * (0.8 + 0.002 * len(a)) < 45 * most else _banded)(a, b, most)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two bags have in common."""
    u, nu = np.unique(x, return_counts=True)
    v, nv = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(nu[i], nv[j]).sum())


def edit_distance(a: np.ndarray, b: np.ndarray, most: int, k: int = K) -> int:
    """At most `most` if and only if the edit distance is; then the number of edits of an alignment, else any larger number."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    same = min(n, m)
    x = np.flatnonzero(a[:same] != b[:same])
    lead = int(x[0]) if len(x) else same
    a, b = a[lead:], b[lead:]
    same = min(len(a), len(b))
    x = np.flatnonzero(a[len(a) - same :][::-1] != b[len(b) - same :][::-1])
    trail = int(x[0]) if len(x) else same
    a, b = a[: len(a) - trail], b[: len(b) - trail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    longest = max(len(a), len(b))
    for q in (1, 2, 3):  # an edit changes at most q runs of q words
        need = longest - q + 1 - q * most
        if need > 0 and (min(len(a), len(b)) < q or _shared(kmer_hashes(a, q), kmer_hashes(b, q)) < need):
            return most + 1
    if len(a) <= 2 * k or len(b) <= 2 * k or longest <= 32:
        return _aligned(a, b, most)
    ga, gb = kmer_hashes(a, k), kmer_hashes(b, k)
    ua, ia, na = np.unique(ga, return_index=True, return_counts=True)
    ub, ib, nb = np.unique(gb, return_index=True, return_counts=True)
    _, pa, pb = np.intersect1d(ua[na == 1], ub[nb == 1], assume_unique=True, return_indices=True)
    pa, pb = ia[na == 1][pa], ib[nb == 1][pb]
    order = np.argsort(pa)
    pa, pb = pa[order], pb[order]
    near = np.abs(pa - pb) <= most  # other diagonals cannot be on an alignment this good
    pa, pb = pa[near], pb[near]
    total, i, j = 0, 0, 0
    for p, q in [*_chain(pa, pb), (len(a), len(b))]:
        over = max(i - p, j - q, 0)  # words that the anchor before has too
        if over >= k:
            continue
        p, q, length = p + over, q + over, k - over
        if p > i or q > j:
            total += int(a[i] != b[j]) if p - i == q - j == 1 else _aligned(a[i:p], b[j:q], most - total)
            if total > most:
                return _aligned(a, b, most)
        i, j = p + length, q + length
    return total


def _chain(pa: np.ndarray, pb: np.ndarray) -> list[tuple[int, int]]:
    """The longest run of anchors that rises in both texts."""
    from bisect import bisect_left

    tails: list[int] = []
    place: list[int] = []
    back = []
    for i, v in enumerate(pb.tolist()):
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
            place.append(i)
        else:
            tails[at], place[at] = v, i
        back.append(place[at - 1] if at else -1)
    out, i = [], place[-1] if place else -1
    while i >= 0:
        out.append((int(pa[i]), int(pb[i])))
        i = back[i]
    return out[::-1]


def similar(a: str | None, b: str | None, least: float = SIMILARITY) -> bool:
    return _alike(word_hashes((a or "").split()), word_hashes((b or "").split()), least)


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    longest = max(len(x), len(y))
    most = int((1 - least) * longest + 1e-9)
    return longest > 0 and edit_distance(x, y, most) <= most


def _sketcher(bands: int, pick: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                words = [t.split() for t in part["text"]]
                keys = [hashlib.sha256(" ".join(w).encode()).digest()[:16] for w in words]
                flat = word_hashes([w for x in words for w in x])
                ends = np.cumsum([len(x) for x in words])
                sketches = [order_minhash(h, bands, pick, k) for h in np.split(flat, ends[:-1])]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "key": keys, "sketch": sketches})

    return run


def _verifier(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at: dict = {}  # each text's words are hashed once a batch
            for side in ("a", "b"):
                for node, text in zip(batch[side], batch[f"text_{side}"], strict=True):
                    if node not in at:
                        at[node] = word_hashes(text.split())
            ok = [_alike(at[a], at[b], least) for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.loc[:, ["a", "b"]].assign(linked=ok)

    return run


def _bagger(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many words a text has, in all and (up to 255) in each hash group."""
    for batch in batches:
        hashes = [word_hashes(t.split()) for t in batch["text"]]
        bags = [np.minimum(np.bincount((h % np.uint64(BAGS)).astype(np.int64), minlength=BAGS), 255).astype(np.uint8).tobytes() for h in hashes]
        yield pd.DataFrame({"node": batch["node"].to_numpy(), "n": [len(h) for h in hashes], "bag": bags})


def _slot_counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts a labelled word of each slot stands: one row a task."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for text in batch["text"]:
            counts += np.bincount((_labelled(word_hashes(text.split())) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    yield pd.DataFrame({"counts": [counts.tobytes()]})


def _adder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for c in batch["counts"]:
            counts += np.frombuffer(c, np.int64)
    yield pd.DataFrame({"counts": [counts.tobytes()]})


def rarest_words(h: np.ndarray, counts: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Of the labelled words of a text (h: its words' hashes) so many, rarest first by the counts of their slots, that two similar texts share one."""
    labelled = _labelled(h)
    order = np.lexsort((labelled, counts[(labelled % np.uint64(len(counts))).astype(np.int64)]))
    return labelled[order[: int((1 - least) * len(h) + 1e-9) + 1]].view(np.int64)


def _rare_word_rows(counts: np.ndarray, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                words = [rarest_words(word_hashes(t.split()), counts, least) for t in part["text"]]
                yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), [len(w) for w in words]), "bucket": np.concatenate(words)})

    return run


def by_rare_words(texts: DataFrame, least: float) -> DataFrame:
    """node, bucket (a rare word) of texts (node, text). What comes to the driver and goes to the tasks is one count a slot."""
    kind = texts.schema["node"].dataType.simpleString()
    sums = texts.mapInPandas(_slot_counter, "counts binary").repartition(8).mapInPandas(_adder, "counts binary").collect()  # 8 rows
    counts = np.sum([np.frombuffer(r["counts"], np.int64) for r in sums], axis=0)
    return texts.mapInPandas(_rare_word_rows(counts, least), f"node {kind}, bucket long")


def _crosser(least: float, take: int):
    """Of the pairs of two blocks of a key's nodes (or of one) that are of different classes and could be similar by their word counts, the `take` likeliest of every two classes, and whether these had more."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["block", "n", "node"])
        node, n = part["node"].to_numpy(), part["n"].to_numpy(np.int64)
        label = pd.factorize(part["label"])[0]
        bag = np.frombuffer(b"".join(part["bag"]), np.uint8).reshape(len(part), BAGS)
        over = n - bag.sum(axis=1, dtype=np.int64)  # words beyond the 255 that a group counts
        first = int((part["block"] == part["lo"]).sum())
        two = part["lo"].iloc[0] != part["hi"].iloc[0]
        found = [np.empty((0, 4), np.int64)]
        for i in range(first):
            start, stop = (first, len(part)) if two else (i + 1, first)
            # Of the lengths, in ascending order, only those from n * least to n / least can be similar.
            low, high = start + np.searchsorted(n[start:stop], n[i] * least - 1), start + np.searchsorted(n[start:stop], n[i] / least + 1, side="right")
            at = low + np.flatnonzero(label[low:high] != label[i])
            longest = np.maximum(n[at], n[i])
            most = ((1 - least) * longest + 1e-9).astype(np.int64)
            both = np.minimum(bag[at], bag[i]).sum(axis=1, dtype=np.int64) + np.minimum(over[at], over[i])
            ok = (longest - both <= most) & (longest - np.minimum(n[at], n[i]) <= most)
            at, left = at[ok], (longest - both)[ok]
            if len(at):
                order = np.lexsort((left, label[at]))
                at, left = at[order], left[order]
                head = np.flatnonzero(np.concatenate([[True], label[at[1:]] != label[at[:-1]]]))
                size = np.diff(np.concatenate([head, [len(at)]]))
                nth = np.arange(len(at)) - np.repeat(head, size)
                keep = nth < take
                found.append(np.stack([np.full(int(keep.sum()), i), at[keep], left[keep], np.where(nth == 0, np.repeat(size, size), 0)[keep]], axis=1))
        if len(found) == 1:
            return pd.DataFrame({"a": node[:0], "b": node[:0], "open": np.empty(0), "more": np.empty(0, bool)})
        x = pd.DataFrame(np.concatenate(found), columns=["i", "j", "left", "many"])
        x["p"], x["q"] = np.minimum(label[x["i"]], label[x["j"]]), np.maximum(label[x["i"]], label[x["j"]])
        x["open"] = x["left"] / np.maximum(n[x["i"]], n[x["j"]])
        x = x.sort_values(["left", "i", "j"], kind="stable")
        classes = x.groupby(["p", "q"])
        x = x.assign(nth=classes.cumcount(), more=classes["many"].transform("sum") > take)
        x = x[x["nth"] < take]
        u, v = node[x["i"]], node[x["j"]]
        return pd.DataFrame({"a": np.maximum(u, v), "b": np.minimum(u, v), "open": x["open"].to_numpy(float), "more": x["more"].to_numpy(bool)})

    return run


def _closer(part: pd.DataFrame, run: np.ndarray, least: float) -> pd.DataFrame:
    """The pairs of each of many small groups (run: which group a row is of, in ascending order) that are of different classes and could be similar by their word counts."""
    node, n, label = part["node"].to_numpy(), part["n"].to_numpy(np.int64), pd.factorize(part["label"])[0]
    bag = np.frombuffer(b"".join(part["bag"]), np.uint8).reshape(len(part), BAGS)
    over = n - bag.sum(axis=1, dtype=np.int64)  # words beyond the 255 that a group counts
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for d in range(1, len(part)):
        i = np.flatnonzero(run[:-d] == run[d:])
        if not len(i):
            break
        longest = np.maximum(n[i], n[i + d])
        most = ((1 - least) * longest + 1e-9).astype(np.int64)
        ok = (label[i] != label[i + d]) & (longest - np.minimum(n[i], n[i + d]) <= most)
        i, longest, most = i[ok], longest[ok], most[ok]
        left = longest - np.minimum(bag[i], bag[i + d]).sum(axis=1, dtype=np.int64) - np.minimum(over[i], over[i + d])
        ok = left <= most
        found.append((i[ok], i[ok] + d, (left / np.maximum(longest, 1))[ok]))
    i, j, open_ = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"i": i, "j": j, "open": open_})


def _in_common(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements rows[i] and rows[j], each without repeats, have in common, for each pair of i and j."""
    size = np.array([len(x) for x in rows])
    start = np.cumsum(size) - size
    values, code = np.unique(np.concatenate(rows), return_inverse=True)
    out, order = np.zeros(len(i), np.int64), np.argsort(i, kind="stable")
    mark = np.zeros(len(values), bool)
    for pairs in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        own = code[start[i[pairs[0]]] :][: size[i[pairs[0]]]]
        mark[own] = True
        for k in range(0, len(pairs), 256):
            some = j[pairs[k : k + 256]]
            of = np.repeat(np.arange(len(some)), size[some])
            at = np.arange(len(of)) + np.repeat(start[some] - (np.cumsum(size[some]) - size[some]), size[some])
            out[pairs[k : k + 256]] = np.bincount(of[mark[code[at]]], minlength=len(some))
        mark[own] = False
    return out


def _candidates(part: pd.DataFrame, least: float) -> pd.DataFrame:
    """i, j (places in part), open: the pairs of different classes that could be similar by their word counts and meet in no bucket that stands before (keys: a node's buckets, the same order for all), of all groups (bucket, lo, hi) of part."""
    key = part[["bucket", "lo", "hi"]].to_numpy(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    size = np.diff(np.concatenate([head, [len(part)]]))
    of = np.repeat(np.arange(len(head)), size)
    few = np.flatnonzero((size <= SMALL)[of])
    out = []
    if len(few):
        x = _closer(part.iloc[few], of[few], least)
        out.append(x.assign(i=few[x["i"]], j=few[x["j"]]))
    cross = _crosser(least, 1 << 40)
    for at, n in zip(head[size > SMALL], size[size > SMALL], strict=True):
        x = cross(part.iloc[at : at + n].assign(node=np.arange(at, at + n)))
        out.append(x[["a", "b", "open"]].set_axis(["i", "j", "open"], axis=1))
    x = pd.concat(out, ignore_index=True)
    if not len(x):
        return x
    x[["i", "j"]] = x[["i", "j"]].astype(np.int64)
    before = [np.empty(0, np.int64) if k is None else k[: int(np.argmax(k == b))] for k, b in zip(part["keys"], part["bucket"], strict=True)]
    x = x[_in_common(before, x["i"].to_numpy(), x["j"].to_numpy()) == 0]
    return x


def _meeting(least: float):
    """The rows that have a candidate."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bucket", "lo", "hi", "node"], ignore_index=True)
        x = _candidates(part, least)
        return part.loc[np.unique(np.concatenate([x["i"], x["j"]])).astype(np.int64), ["group", "bucket", "node", "block", "lo", "hi"]]

    return run


def _linker(least: float):
    """The links among the candidates, the likeliest tested first, without those of nodes that links before made one class."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bucket", "lo", "hi", "node"], ignore_index=True)
        x = _candidates(part, least)
        node, place = part["node"].to_numpy(), pd.factorize(part["node"])[0]
        words: dict = {}
        for at in np.unique(np.concatenate([x["i"], x["j"]])).astype(np.int64).tolist():
            if place[at] not in words:
                words[place[at]] = word_hashes(part["text"].iloc[at].split())
        if len(x) and sum(len(h) for h in words.values()) <= MOST_WORDS:
            held = [_labelled(words[k]) if k in words else np.empty(0, np.uint64) for k in range(int(place.max()) + 1)]
            i, j = place[x["i"]], place[x["j"]]
            longest = np.maximum(*(np.array([len(held[k]) for k in y]) for y in (i, j)))
            x = x[longest - _in_common(held, i, j) <= ((1 - least) * longest + 1e-9).astype(np.int64)]
        root: dict = {}

        def top(label):
            while (above := root.get(label, label)) != label:
                root[label] = label = root.get(above, above)
            return label

        x = x.sort_values(["open", "i", "j"], kind="stable")
        label, links = part["label"].to_numpy(), []
        for i, j in zip(x["i"].tolist(), x["j"].tolist(), strict=True):
            la, lb = top(label[i]), top(label[j])
            if la != lb and _alike(words[place[i]], words[place[j]], least):
                root[max(la, lb)] = min(la, lb)
                links.append((i, j))
        i, j = np.array(links, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": np.maximum(node[i], node[j]), "b": np.minimum(node[i], node[j])})

    return run


def _groups(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (bucket, node) with their classes, and of each bucket with several classes its rows (many), its largest class (major) and how many rows are of others (minor)."""
    of = written(rows.join(labels, "node").select("bucket", "node", "label"), "near-of")
    each = of.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("many"), F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("classes"))
    mixed = each.where("classes > 1").select("bucket", "many", F.col("top.label").alias("major"), (F.col("many") - F.col("top.c")).alias("minor"))
    return of, written(mixed, "near-mixed")


def _blocks(of: DataFrame, mixed: DataFrame) -> DataFrame:
    """bucket, node, block, and the two blocks (lo, hi) whose pairs meet there: a bucket of up to SIDE rows is one block; in a larger one blocks of its largest class meet all others, but not each other."""
    x = dealt_join(of, mixed, "bucket", hot=hot_keys(of, "bucket", counts=mixed.select("bucket", "many")))
    zero, at, major = F.lit(0).cast("long"), F.xxhash64("node"), F.col("label") == F.col("major")
    whole = x.where(F.col("many") <= SIDE).select("bucket", "node", "many", zero.alias("block"), zero.alias("lo"), zero.alias("hi"))
    small, large = F.ceil(F.col("minor") / SIDE), F.ceil((F.col("many") - F.col("minor")) / SIDE)
    x = x.where(F.col("many") > SIDE).withColumn("block", F.when(major, small + F.pmod(at, large)).otherwise(F.pmod(at, small)).cast("long"))
    last = F.when(major, small).otherwise(small + large).cast("long") - 1
    x = x.withColumn("with", F.explode(F.sequence(zero, last)))
    return whole.unionByName(x.select("bucket", "node", "many", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi")))


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of few links by union-find: the smaller root takes the other."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    x = pd.concat(parts)
    node, code = np.unique(np.concatenate([x["a"].to_numpy(), x["b"].to_numpy()]), return_inverse=True)
    root = list(range(len(node)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(code[: len(x)].tolist(), code[len(x) :].tolist(), strict=True):
        i, j = top(i), top(j)
        root[max(i, j)] = min(i, j)
    yield pd.DataFrame({"node": node, "label": node[[top(i) for i in range(len(node))]]})


def components(links: DataFrame, name: str = "classes", most: int = FEW_LINKS) -> DataFrame:
    """node, label (the smallest node of its component) of every node in links (a, b).

    Up to `most` links are no load for one task, which unites them. More are joined in rounds over all tasks: each takes the
    smallest label around and then that label's own label; rounds go on until none changes.
    """
    links = written(links.select("a", "b").distinct(), f"{name}-links")
    if links.count() <= most:
        kind = links.schema["a"].dataType.simpleString()
        return written(links.coalesce(1).mapInPandas(_united, f"node {kind}, label {kind}"), f"{name}-labels")
    both = written(links.union(links.select(F.col("b"), F.col("a"))).distinct(), f"{name}-both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        near = dealt_join(both, labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around"))
        step = written(labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "around").alias("new")), f"{name}-step")
        hop = labels.where("node <> label").select(F.col("node").alias("new"), F.col("label").alias("over"))
        step = written(dealt_join(step, hop, "new", "left").select("node", "was", F.least("new", "over").alias("label")), f"{name}-labels")
        labels = step.select("node", "label")
        if step.where(F.col("was") != F.col("label")).isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """labels (node, label of every node) after these links too: components of the links between classes, which are few, and one join back."""
    of = lambda c, out: labels.select(F.col("node").alias(c), F.col("label").alias(out))
    links = written(links.select("a", "b"), f"{name}-new")
    n = links.count()
    if not n:
        return labels
    hot = lambda c: hot_keys(links, c) if n > ONE_TASK else None
    between = dealt_join(dealt_join(links, of("a", "la"), "a", hot=hot("a")), of("b", "lb"), "b", hot=hot("b"))
    between = written(between.where("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")), f"{name}-between")
    if between.isEmpty():
        return labels
    roots = components(between, name).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return written(dealt_join(labels, roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), f"{name}-merged")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, pick: int = PICK, k: int = K) -> DataFrame:
    """doc_id, class_id (the smallest id of the class), n_links (tested links of its node), is_copy (same words as a smaller id).

    One row for each row of docs. Ids may be of any type that has an order (strings are ordered as such). Rows that share an
    id share a class: that of the smallest id among the copies of their texts. Null, empty and white-space texts, and rows
    without an id, are classes of their own: their class_id is their id (null for null). Very long texts are read whole. No
    rows give no rows. Other columns are not read.
    """
    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    real = F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")
    sketches = written(base.where(real).mapInPandas(_sketcher(bands, pick, k), f"doc_id {kind}, key binary, sketch array<bigint>"), "near-sketches")
    nodes = written(sketches.groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("many"), F.first("sketch").alias("sketch")), "near-nodes")
    member = dealt_join(sketches.select("doc_id", "key"), nodes.select("key", "node"), "key", counts=nodes.select("key", "many")).groupBy("doc_id").agg(F.min("node").alias("node"))
    rows = nodes.select("node", F.explode("sketch").alias("bucket"))
    lead = written(rows.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("many")).where("many > 1"), "near-leads")
    hot = hot_keys(rows, "bucket", counts=lead.select("bucket", "many"))  # of all that follows, until rows grow
    rows = written(dealt_join(rows, lead, "bucket", hot=hot), "near-buckets")  # bucket, node, b (the smallest node there), many
    texts = base.where(real).join(rows.select("node").distinct(), F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "text")
    texts = written(texts, "near-texts")

    def tested(pairs: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        pairs = written(pairs, "near-pairs")
        n = pairs.count()
        of = lambda c: hot_keys(pairs, c) if n > ONE_TASK else None
        checked = dealt_join(dealt_join(pairs, side("b"), "b", hot=of("b")), side("a"), "a", hot=of("a")).mapInPandas(_verifier(least), f"a {kind}, b {kind}, linked boolean")
        return written(checked.groupBy("a", "b").agg(F.max("linked").alias("linked")), "near-tested")

    every = rows.select("node").distinct()
    pairs = rows.where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("shared"))
    pairs = pairs.groupBy("a").agg(F.min("b").alias("b"), F.max_by("b", "shared").alias("most"))
    first = tested(pairs.select("a", F.explode(F.array_distinct(F.array("b", "most"))).alias("b")))
    begun = components(first.where("linked"), "near-first")
    labels = written(every.join(begun, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "near-all")
    of, mixed = _groups(rows.select("bucket", "node"), labels)
    if not mixed.isEmpty():
        meet = _blocks(of, mixed.where(F.col("many") <= CROWD))
        crowded = mixed.where(F.col("many") > CROWD).select("bucket")
        if not crowded.isEmpty():
            crowd = dealt_join(of, crowded, "bucket", hot=hot).select("node").distinct()
            words = written(by_rare_words(written(texts.join(crowd, "node", "left_semi"), "near-crowd"), least), "near-words")
            meet = meet.unionByName(_blocks(*_groups(words, labels)))
        met = written(meet, "near-meet")
        n = met.count()
        small = F.pmod(F.xxhash64("bucket"), F.lit(n // AT_ONCE + 1))  # many small groups in one
        meet = met.select("bucket", "node", "block", "lo", "hi", F.when(F.col("many") <= SMALL, small).otherwise(F.xxhash64("bucket", "lo", "hi")).alias("group"))
        keys = met.groupBy("node").agg(F.sort_array(F.collect_set(F.struct(-F.col("many"), "bucket"))).alias("keys"))
        keys = keys.select("node", F.when(F.size("keys") <= MOST_KEYS, F.col("keys.bucket")).alias("keys"))  # without its keys a node's pairs may count more than once
        bags = texts.join(met.select("node").distinct(), "node", "left_semi").mapInPandas(_bagger, f"node {kind}, n long, bag binary")
        bags = written(bags.join(keys, "node").join(labels, "node"), "near-bags")
        open_ = meet.join(bags, "node").groupBy("group").applyInPandas(_meeting(least), f"group long, bucket long, node {kind}, block long, lo long, hi long")
        open_ = written(open_, "near-open")
        links = open_.join(bags, "node").join(texts, "node").groupBy("group").applyInPandas(_linker(least), f"a {kind}, b {kind}")
        links = written(links.distinct(), "near-links").withColumn("linked", F.lit(True))
        first, labels = first.unionByName(links), merged(labels, links, "near-more")
    links = first.where("linked").select("a", "b").distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of_node = labels.join(degree, "node", "left")
    of_doc = dealt_join(written(member, "near-members"), of_node, "node", "left").withColumnRenamed("node", "__node").withColumnRenamed("doc_id", "__doc")
    out = docs.select(F.col(id_col).alias("doc_id")).join(of_doc, F.col("doc_id") == F.col("__doc"), "left")
    return out.select("doc_id", F.coalesce("label", "__node", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("__node") != F.col("doc_id"), F.lit(False)).alias("is_copy"))
