"""Ranked search, quality rules and the conversation trie against brute force, SQL and held-out labels, with nulls, ties and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from factlens.llm import near, quality, queries, ranked, trie

DOCS = "doc_id long, text string, item string, score string, shard string, n string, part string"


def docs_of(spark, rows):
    """With clashing extra columns."""
    return spark.createDataFrame([(i, t, "x", "y", "z", None, "p") for i, t in rows], DOCS)


def words(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{min(r.randrange(vocabulary), r.randrange(vocabulary))}" for _ in range(n))


@pytest.mark.parametrize("name", ["op11_ranked", "op13_trie"])
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, df.select(columns).collect())) and sorted(tuple(r) for r in df.select(columns).na.fill(-1).collect()) == sorted(tuple(-1 if v is None else v for v in r) for r in want)


PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_rank(docs, items, k=10):
    bags = [(i, PATTERN.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_all = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    counts = [(i, len(b), Counter(b)) for i, b in bags]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, n, c in counts:
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_all))) for t in PATTERN.findall((text or "").translate(LOWER)) if c[t])
            if s > 0:
                found.append((-s, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rank_rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_ranked_search_is_exact(spark):
    docs = [(i, words(i, 5 + i % 60)) for i in range(400)] + [(1000 + i, words(7, 30)) for i in range(60)]  # sixty ties
    docs += [(-5, None), (None, words(7, 30)), (2000, ""), (2001, "Ünï W1 w1-W2\x00w3\x7fW4 Straße"), (3, words(3, 8)), (2002, words(5, 4000)), (2003, " .,;")]
    items = [(i, words(1000 + i, 12)) for i in range(20)] + [(50, words(7, 30)), (50, "w1 w1 w1 ünï STRASSE straße"), (51, None), (52, "nothing here"), (None, "w2 w3"), (53, "w0")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = ranked.rank_documents(docs_of(spark, docs).repartition(5), asked, shard=40, cluster=4)
    assert rank_rows(got) == brute_rank(docs, items)
    assert rank_rows(ranked.rank_documents(docs_of(spark, docs), asked, 3, batch=7, shard=100, cluster=8)) == brute_rank(docs, items, 3)


def test_ranked_search_of_nothing(spark):
    none, one = docs_of(spark, []), docs_of(spark, [(1, "a b"), (2, None)])
    ask = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    assert ranked.rank_documents(none, ask([(1, "a")])).count() == 0
    assert ranked.rank_documents(one, ask([])).count() == 0
    assert rank_rows(ranked.rank_documents(one, ask([(1, "A")]))) == brute_rank([(1, "a b"), (2, None)], [(1, "A")])


def test_bisection_brings_like_documents_together():
    rng = np.random.default_rng(0)
    topic = rng.integers(0, 8, 512)
    term = np.concatenate([np.where(rng.random(20) < 0.8, t * 50 + rng.integers(0, 50, 20), rng.integers(0, 400, 20)) for t in topic])
    doc = np.repeat(np.arange(512), 20)
    cost = lambda part: sum(d * math.log2(64 / (d + 1)) for d in Counter(zip(part[doc], term)).values())
    part, levels = ranked.bisect(doc, term, 512, 400, 3)
    assert sorted(Counter(part).values()) == [64] * 8 and len(levels) == 3
    assert cost(part) < 0.85 * cost(np.arange(512) // 64)
    tree = ranked.fit_tree([term[i * 20 : i * 20 + 20] for i in range(0, 512, 2)], 400, 3)
    leaf = tree.leaves(doc, term, 512)  # the other half of the documents goes down the same tree
    assert sum(max(Counter(topic[leaf == v]).values()) for v in set(leaf)) > 0.6 * 512


def test_search_leaves_clusters_out(spark):
    docs = [(i, " ".join(f"t{i % 16}x{v}" for v in random.Random(i).sample(range(30), 12)) + " common" * (1 + i % 9)) for i in range(2000)]
    voc = {t: i for i, t in enumerate(sorted({w for _, t in docs for w in ranked.terms_of(t)}))}
    index, n, _, df = ranked.build_index(docs_of(spark, docs).select("doc_id", "text"), voc)
    asked = np.array(sorted(voc[t] for t in (b"t3x1", b"t3x2", b"t3x3", b"common")))
    item = ranked.Item(0, asked, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked]))
    shards = [ranked._Shard(r) for r in index.collect()]
    bound = lambda s: int((s.best[item.found(s.terms)[0]] * item.found(s.terms)[1]).sum())
    shards.sort(key=lambda s: -bound(s))
    best, first = ranked.visit(shards[0], item, 1, 10)
    done = [first] + [ranked.visit(s, item, -best[-1][0], 10)[1] for s in shards[1:] if bound(s) >= -best[-1][0]]
    assert sum(done) < sum(len(s.ids) // ranked.CLUSTER + 1 for s in shards) / 2


def test_rules_find_junk(spark):
    r = random.Random(4)
    good = [" ".join(r.choice("abcdefg") * r.randrange(2, 9) + str(i)[:1] for i in range(r.randrange(20, 90))) for _ in range(200)]
    bad = [" ".join(w + "$%&" for w in t.split()) if i % 2 else " ".join(x for w in t.split()[:15] for x in [w] * 6) for i, t in enumerate(good[:60])]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, None), (900, ""), (900, ""), (901, "x" * 300_000), (902, " \n\n ")]
    labels = spark.createDataFrame([(i, int(i < 200), "t") for i in range(260)] + [(None, 1, "t"), (3, None, "t"), (5, 0, "t")], "doc_id long, quality int, text string")
    docs = docs_of(spark, rows)
    model = quality.fit_labelled(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    held = {x.doc_id: x.score for x in got if x.doc_id is not None and x.doc_id < 260 and zlib.crc32(str(x.doc_id).encode()) % 4 == 2}
    assert sum((s >= 0.7) == (i < 200) for i, s in held.items()) >= 0.95 * len(held) > 40
    # The compiled column is the model.
    x = {r.doc_id: r.x for r in quality.with_statistics(docs, "text", [docs.doc_id], "x").collect()}
    names = [i for i in x if i is not None and i < 260]
    want = dict(zip(names, model.score(np.array([x[i] for i in names])), strict=True))
    assert all(abs(want[g.doc_id] - g.score) < 1e-9 for g in got if g.doc_id in want)
    assert any(len(rule.terms) > 1 for rule, _ in model.rules) or model.rules
    assert quality.score_quality(docs_of(spark, []), model).count() == 0
    for empty in (quality.fit_labelled(docs, labels.limit(0)), quality.fit_labelled(docs_of(spark, []), labels)):
        assert empty.rules == [] and {r.score for r in quality.score_quality(docs.limit(3), empty).collect()} == {0.5}


def test_statistics(spark):
    rows = [(0, "Ab ab ab, CD|x!\n12́ #é\n12́ #é"), (1, None), (2, "a"), (3, " a a ")]
    docs = docs_of(spark, rows)
    x = {r.doc_id: dict(zip(quality.STATISTICS, r.x, strict=True)) for r in quality.with_statistics(docs, "text", [docs.doc_id], "x").collect()}
    t = rows[0][1]
    n, k = len(t), len(t.split())
    want = {"log_chars": math.log(n), "chars_per_word": n / k, "letter_share": sum(c.isalpha() for c in t) / n, "upper_share": 3 / sum(c.isalpha() for c in t), "digit_share": 4 / n, "symbols_per_word": 2 / k, "bars_per_word": 1 / k, "shouts_per_word": 1 / k, "stops_per_word": 1 / k, "repeated_word_share": 0, "distinct_word_share": len(set(t.split())) / k, "repeated_line_share": 1 / 3, "words_per_line": k / 3}
    assert {s: round(v, 9) for s, v in x[0].items()} == {s: round(v, 9) for s, v in want.items()} | {"repeated_word_share": round(0 / k, 9)}
    assert x[1]["log_chars"] == 0 and x[3]["repeated_word_share"] == 0.5 and all(v is not None for r in x.values() for v in r.values())


def test_lasso_gives_zeros():
    rng = np.random.default_rng(1)
    h = (rng.random((600, 30)) < 0.4).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(3 * h[:, 0] - 3 * h[:, 1])))).astype(float)
    b, w = quality.lasso(h, y, 0.02)
    assert w[0] > 0.5 and w[1] < -0.5 and (np.abs(w[2:]) < 1e-6).sum() > 20
    g = h.T @ (1 / (1 + np.exp(-(b + h @ w))) - y) / 600  # at the optimum: |g| <= penalty, with its sign where w is not 0
    assert np.abs(g).max() < 0.021 and abs(g[0] + 0.02) < 1e-3 and abs(g[1] - 0.02) < 1e-3


def brute_trie(turns):
    of = {}
    for c, turn, role, text in turns:
        if c is not None:
            of.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    seq = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in of.items()}
    built = {}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(seq.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    nodes = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for p, cs in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        ends = ",".join(str(c) for c in sorted(cs) if built[c] == p)
        out.append((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), kids(p), sum(kids(q) == 0 for q in under), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=str)


def test_trie(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a node's ids come in several strings
    r = random.Random(2)
    turns = [(c, t, r.choice(["user", "user", None]), r.choice(["a", "b", "日本", "", None])) for c in [*range(0, 60), *range(100, 140), *range(-7, 0), 250, 251, 252, 310] for t in range(r.randrange(1, 9))]
    turns += [(400, t, "user", "x") for t in range(23)] + [(c, t, "user", "x") for c in range(401, 430) for t in range(23)]  # a long one and its copies
    turns += [(500, None, "u", "null first"), (500, 1, "u", "b"), (500, 1, "u", "b"), (500, 1, "a", "b"), (500, 1, "u", "c"), (None, 1, "u", "x"), (601, 0, "u", "gone")]
    df = spark.createDataFrame([(c, t, a, b, 1, "n") for c, t, a, b in turns], "conv_id long, turn long, role string, text string, depth int, name string")
    assert trie_rows(trie.conversation_trie(df.repartition(6))) == brute_trie(turns)
    assert trie.conversation_trie(df.limit(0)).count() == 0
    assert trie_rows(trie.conversation_trie(df.where("conv_id = 601"))) == brute_trie([t for t in turns if t[0] == 601])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rare_words_lose_no_similar_pair_and_pair_no_crowd(spark):
    r = random.Random(3)
    shared = [f"licence{i}" for i in range(30)]

    def crowd(n):
        return [shared + [f"u{r.randrange(40_000)}" for _ in range(60)] for _ in range(n)]

    def pairs(texts):
        rows = near.by_rare_words(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string").repartition(3), near.SIMILARITY).collect()
        of = {}
        for x in rows:
            of.setdefault(x.bucket, set()).add(x.node)
        return {(a, b) for s in of.values() for a in s for b in s if a < b}

    one, two = len(pairs(crowd(250))), len(pairs(crowd(500)))
    assert two < 250 * 249 / 2 / 10 and two <= 5 * max(one, 20)
    texts = crowd(40)
    for t in crowd(40):  # like pairs at the edge: a fifth of the words changed, with repeats
        t = t + ["the"] * r.randrange(20)
        like = list(t)
        for i in r.sample(range(len(like)), int(0.2 * len(like))):
            like[i] = f"new{r.randrange(10_000)}"
        texts += [t, like]
    got = pairs(texts)
    for i in range(len(texts)):
        for j in range(i):
            if near.similar(" ".join(texts[i]), " ".join(texts[j])):
                assert (j, i) in got


def test_a_crowd_with_a_common_passage_keeps_its_classes(spark, monkeypatch):
    monkeypatch.setattr(near, "CROWD", 20)
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + words(i, 30, 5000)) for i in range(120)]
    base = passage.split() + words(999, 60, 5000).split()
    for i in range(60):  # a group of near copies in the crowd
        t = list(base)
        for k in r.sample(range(len(t)), r.randrange(3, 13)):
            t[k] = f"e{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(t)))
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if j < i and near.similar(a, b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    got = {x.doc_id: x.class_id for x in near.near_duplicate_classes(docs_of(spark, rows)).collect()}
    assert got == {i: top(i) for i, _ in rows} and len(set(got.values())) < 150


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("most", [0, 1 << 16])
def test_components_in_one_task_and_in_rounds(spark, kind, most):
    """Chains, stars, a loop of its own, repeated links and none at all; both ways equal a plain search."""
    r = random.Random(3)
    links = [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)] + [(7, 7), (1, 2), (2, 1), (1, 2)]
    links += [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    links = [(str(a), str(b)) for a, b in links] if kind == "string" else links
    label = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = near.components(spark.createDataFrame(links, f"a {kind}, b {kind}"), most=most)
    assert {r.node: r.label for r in got.collect()} == label and got.count() == len(label)
    assert near.components(spark.createDataFrame([], f"a {kind}, b {kind}"), most=most).count() == 0


def test_near_tables_do_not_hold_the_pairs_of_a_crowd(spark, monkeypatch):
    """500 texts share a passage of a third of their words, or of four fifths: what is written grows with the texts, not with their pairs, and no link is lost."""
    rng, sizes, keep = np.random.default_rng(29), {}, near.written

    def seen(df, name):
        out = keep(df, name)
        if {"a", "b"} <= set(df.columns):
            sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near, "written", seen)
    passage, common = [f"p{k}" for k in range(20)], ["so", "it", "is"] * 30  # a word that stands often says little, however often
    rows = [(i, " ".join([*passage, *(f"w{w}" for w in rng.integers(0, 3000, 40))])) for i in range(400)]
    rows += [(400 + i, " ".join([*common, *(f"w{w}" for w in rng.integers(0, 3000, 18 + i % 8))])) for i in range(100)]
    texts = [t.split() for _, t in rows]
    got = {x.doc_id: x.class_id for x in near.near_duplicate_classes(docs_of(spark, rows)).collect()}
    assert sum(sizes.values()) < 12 * len(rows), sizes
    sketch = [near.order_minhash(near.word_hashes(t)) for t in texts]
    label = {i: i for i in got}
    for a in range(500):
        for b in range(400 if a >= 400 else 0, a):
            if label[a] != label[b] and len(np.intersect1d(sketch[a], sketch[b])) and near.similar(rows[a][1], rows[b][1]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert got == label


def test_near_alignment_by_bits_is_that_in_a_band():
    rng = np.random.default_rng(31)
    for _ in range(500):
        a = rng.integers(0, 12, rng.integers(0, 60)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 4)) if len(a) and rng.random() < 0.5 else rng.integers(0, 12, rng.integers(0, 60)).astype(np.uint64)
        most = int(rng.integers(0, 60))
        assert near._bitwise(a, b, most) == near._banded(a, b, most)
