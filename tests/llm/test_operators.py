"""The corpus operators against brute force, exact round trips and held-out labels, with nulls, ties and empty tables."""

import array
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from factlens.llm import html_text, maxscore, media, near, packing, pieces, sharding, simple8b, substring, toxicity
from factlens.llm.tokens import ChunkEncoder, vocabulary_path

BYTE, WORD, PIECE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, node string, score string"
ODD = ["", " ", "\n", "a  b\n\n c ", "\ta b", "x\n", "<|endoftext|> a", "é́ ́x Σ ΣΑΣ\xa0y 's don't\x1cfoo 12 34", "  lead", "a \n b", "▁x ▁▁ y", "word, word. 日本語 🙂"]


def docs_of(spark, rows):
    """With clashing extra columns."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z") for i, t in rows], SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ko", "ti", "re", "shu", "mé"]) for _ in range(1 + r.randrange(vocabulary) % 4)) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs():
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100, None), (101, None), (None, "a row without an id"), (102, prose(1, 9000)), (103, prose(2, 120)), (103, prose(2, 120)), (104, prose(2, 120))]
    return rows


def ids_by_library(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(name))
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_chunks_give_the_librarys_ids(name):
    texts = [*ODD, "a <|endoftext|> b", "a<|endoftext|>b  c", "x <|startoftext|>\n<|endoftext|>", "<|ENDOFTEXT|> y", *(prose(s, 200) for s in range(5)), "A" * 500 + " \t " + "b,c.d!" * 30, "x́ ́ y\r\n z\x85w"]
    for got, text in zip(ChunkEncoder(vocabulary_path(name), keep=50).encode(texts), texts, strict=True):
        assert array.array("I", got).tolist() == ids_by_library(name, text), text


def test_packing(spark, odd_docs):
    out = packing.pack_documents(docs_of(spark, odd_docs).repartition(2), vocabulary_path(BYTE), with_ids=True).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length <= 2048
    want = sorted((str(i), *ids_by_library(BYTE, t), 1) for i, t in odd_docs)
    got = []
    for (i, n), parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        copies = sum(r.start == 0 for r in parts)
        for c in range(copies):
            ids = [x for r in parts[c::copies] for x in r.ids]
            assert len(ids) == n
            got.append((str(i), *ids))
    assert sorted(got) == want
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs_of(spark, []), vocabulary_path(BYTE)).count() == 0


def test_packing_balances_cost_and_pads_little():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 6000, 500)
    pieces_, filled = packing.assign(lengths)
    assert filled.sum() == lengths.sum() and len(filled) == -(-lengths.sum() // 2048) and filled.max() <= 2048
    pieces_, filled = packing.assign(np.full(64, 32), 2048 // 2, 1.0, 1.0)
    assert len(set(filled)) == 1


def test_toxicity(spark, sf_dir):
    lengths = np.array([3, 0, 5, 1])
    rng = np.random.default_rng(3)
    e, tr = rng.normal(size=9) * 2, (0.1, -0.5, 0.3, 0.9)
    p, _ = toxicity.marginals(e, lengths, tr)
    t, at = np.array(tr).reshape(2, 2), 0
    for n in lengths:
        z, m = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            if n:
                w = np.exp(np.logaddexp(t[0, y[0]], t[1, y[0]]) + sum(e[at + i] * y[i] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n)))
                z, m = z + w, m + w * np.array(y)
        if n:
            assert np.allclose(p[at : at + n], m / z)
        at += n
    words = [prose(s, 60) for s in range(120)]
    bad = [w.replace(" ", " zurgle ", 3) if i % 3 else w.replace(" ", " FRABBED ", 3) for i, w in enumerate(words[:40])]
    model = toxicity.fit(bad[:30] + words[40:100], [1] * 30 + [0] * 60)
    rows = [(i, t) for i, t in enumerate([*bad[30:], *words[100:], None, ""])] + [(None, bad[0]), (0, bad[30])]
    got = {(r.doc_id, len(r.spans)): r for r in toxicity.score_toxicity(docs_of(spark, rows), model).collect()}
    assert all(r.score >= 0.7 and r.spans for (i, _), r in got.items() if i is None or i < 10)
    assert all(r.score < 0.5 and not r.spans for (i, _), r in got.items() if i is not None and i >= 10)
    r = next(r for (i, _), r in got.items() if i == 1)
    assert {rows[1][1][s.start : s.stop].lower() for s in r.spans} <= {"zurgle", "frabbed"}
    plain = toxicity.score_toxicity(docs_of(spark, rows), toxicity.fit([], []))
    assert {x.score < 0.7 for x in plain.collect()} == {True}
    assert toxicity.score_toxicity(docs_of(spark, []), model).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 0, None), (3, 1, 0), (3, 1, 0)], "doc_id long, toxic int, extra int")
    assert toxicity.fit_labelled(docs_of(spark, rows), labels).weights == {}


def test_toxicity_of_a_very_long_text(spark):
    words = [prose(s, 60) for s in range(100)]
    model = toxicity.fit([w.replace(" ", " zurgle ", 3) for w in words[:30]] + words[30:], [1] * 30 + [0] * 70)
    long = prose(7, 250_000)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs_of(spark, [(1, long), (2, long[:900_000] + " zurgle zurgle zurgle " * 2000)]), model).collect()}
    assert got[1].score < 0.5 and not got[1].spans
    assert got[2].score >= 0.7 and got[2].spans[0].start >= 900_000


def test_toxicity_fit_reads_no_more_than_its_bounds(spark, monkeypatch):
    rows = [(i, prose(i, 50)) for i in range(200)] + [(900, prose(1, 5000)), (5, prose(900, 50))]
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(200), 900]], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append(texts))
    toxicity.fit_labelled(docs_of(spark, rows), labels, held_out=None, max_chars=30_000, max_docs=150)
    toxicity.fit_labelled(docs_of(spark, rows), labels, held_out=None, max_docs=40)
    for texts, chars, docs in ((seen[0], 31_000, 150), (seen[1], 10**9, 40)):
        assert 0 < len(texts) <= docs and sum(map(len, texts)) <= chars
    assert all(len(t) <= 300 for t in seen[0])


def test_toxicity_held_out(spark):
    from factlens.llm.queries import op2_toxicity

    d = "/root/testdata/sf0.01"
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in op2_toxicity(spark, d).collect() if r.held_out and r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    hit = sum(r.predicted and y[r.doc_id] for r in rows)
    assert hit >= 0.8 * sum(y[r.doc_id] for r in rows) and sum(r.predicted for r in rows) == hit


PAGE = """<html><head><title>t</title><style>x{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/>News</a></ul></nav>
<header>Site</header><div class="cookie-notice">We use cookies</div><div id=wrap><h1>A &lt;title&gt;</h1><p>First &amp; second <b>bold<br>line</b>
<p>Unclosed   paragraph&nbsp;with &eacute;<script>var a = "<p>";</script> more text that is long enough to be the article of this page.
<ul><li>one<li>two</ul><table><tr><td>cell</table><aside>side</aside></div><section class="comments"><p>Nice post, reader comment here, quite long too.</section>
<form><p>Subscribe</form><footer>&copy; all</footer></body>"""


def test_html(spark):
    assert html_text.main_text(PAGE).split("\n") == ["A <title>", "First & second bold line", "Unclosed paragraph with é more text that is long enough to be the article of this page.", "one", "two", "cell"]
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, ""), (3, "v", "<<< & <b"), (4, "w", "<div>" * 5000 + "<p>" + prose(1, 20000)), (5, "x", "<nav>only a menu</nav>"), (6, "y", "plain text")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r for r in html_text.extract_main_text(df).collect()}
    assert all(r.n_chars == len(r.text) for r in got.values()) and html_text.extract_main_text(df).count() == len(rows)
    assert got[2, None].text == got[None, None].text == got[5, "x"].text == "" and got[6, "y"].text == "plain text" and got[4, "w"].text == " ".join(prose(1, 20000).split())
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_html_keeps_what_is_no_listed_kind():
    page = "<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p title=O'Brien>This isn't lost.</p><p>{}</p></article><footer>f</footer>"
    for inner in ("<math><mi>x</mi></math>", "<canvas>seen</canvas>", "<object>seen</object>", "<map>seen</map>", "<span hidden>seen</span>"):
        assert html_text.main_text(page.format(inner)).startswith("Title\nThis isn't lost.\n"), inner
    for name in ('class="tags"', 'class="side"', 'class="social proof"', 'class="comment-free"', 'class="related quote"', "id=search", 'class="has-sidebar"', 'class="headers-explained"'):
        assert html_text.main_text(page.format("").replace("<p>", f"<p {name}>seen")).endswith("seen"), name
    for name in ("class=ad", "class='x cookie-notice'", "id=comments", "class=commentList", "role=navigation", "class='post-comments'", "class=site-footer"):
        assert html_text.main_text(page.format("").replace("<p>", f"<p {name}>gone")) == "Title\nThis isn't lost.", name
    wrapped = page.format("body text").replace("<body>", "<body><form class='page-overlay'><div class=sidebar>").replace("<footer>", "</div></form><footer>")
    assert html_text.main_text(wrapped) == "Title\nThis isn't lost.\nbody text"
    own = page.format("body text").replace("<h1>", "<header><h1>").replace("</h1>", "</h1></header>")
    assert html_text.main_text(own) == "Title\nThis isn't lost.\nbody text"
    many = "<article><p>The one article of this page.</p><section id=comments>" + "<article class=comment><p>A long reader comment that says much more than it.</p></article>" * 9 + "</section></article>"
    assert html_text.main_text(many) == "The one article of this page."
    assert html_text.main_text("<p a=\"x>y</p> <b c='>kept</b>") == "y\nkept"
    assert html_text.main_text("a < b <3 <!-- c --!> d <!--> e <?x?> f </ g> h") == "a < b <3 d e f h"


def test_html_without_article_elements(spark, sf_dir):
    """The densities alone find the article: every page of the table, its article turned into a plain div, gives the same text."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for h in pages:
        want = html_text.main_text(h)
        assert html_text.main_text(h.replace("<article>", "<div>").replace("</article>", "</div>")) == want
        assert want in html_text.main_text(re.sub(r"(</?)(article|nav|footer)>", r"\1div>", h).replace(' class="ad"', ""))  # no names at all: nothing of the article goes


def test_html_takes_time_by_length():
    import time

    paragraph = "<p>" + prose(4, 60) + "</p>"
    for page in ("<div>" * 100_000 + "<p>deep", '<a "x ' * 100_000, "<b>foo<div>x" * 50_000, "<ul><li>x" * 50_000, '<a b="x ' * 100_000 + ">y", "<p><table><tr><td>x" * 30_000, "<article>" + paragraph * (5_000_000 // len(paragraph))):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 20


def test_html_on_pages(spark, sf_dir):
    import html

    for r in html_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=("page_id", "html")).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_maxscore(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 9)), 3)
    x[50:90] = x[7]  # ties
    rows = [(i * 5, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(4000, None, 1), (4020, [1.0, None], 1), (4040, [float("nan")] * 9, 1), (4060, [float("inf")] * 9, 1), (4080, [], 1), (None, [1.0] * 9, 1), (4100, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    v = maxscore.integer_vectors(df, "vec_id", "embedding")
    ok = {i: [int(np.floor(64 * float(np.float32(c)))) for c in e] for i, e, _ in rows if i is not None and e is not None and all(c is not None and np.isfinite(c) for c in e)}
    for shard_rows in (64, 8192):
        got = {}
        for r in maxscore.top_k(v, v.where("id % 20 = 0"), 20, shard_rows=shard_rows, block_queries=7).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        assert set(got) == {i for i in ok if i % 20 == 0}
        for q, have in got.items():
            s = sorted((-sum(a * b for a, b in zip(ok[q], e)), i) for i, e in ok.items() if i != q)[:20]  # noqa: B905
            assert [have[k + 1] for k in range(len(have))] == [(i, -n) for n, i in s]
    twice = v.where("id <= 300").union(v.where("id <= 300"))  # repeated candidates each count, repeated queries do not
    got = sorted(tuple(r) for r in maxscore.top_k(twice, twice.where("id = 100"), 3).collect())
    best = sorted((-sum(a * b for a, b in zip(ok[100], e)), i) for i, e in ok.items() if i != 100 and i <= 300)  # noqa: B905
    assert got == [(100, 1, best[0][1], -best[0][0]), (100, 2, best[0][1], -best[0][0]), (100, 3, best[1][1], -best[1][0])]
    with pytest.raises(Exception, match="too large"):
        huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
        maxscore.top_k(maxscore.integer_vectors(huge, "vec_id", "embedding"), maxscore.integer_vectors(huge, "vec_id", "embedding")).collect()
    assert maxscore.top_k(v.limit(0), v.limit(0)).count() == 0
    assert maxscore.top_k(v.limit(3), v.limit(3)).count() == 6


def test_maxscore_reads_fewer_values_than_all():
    """Sparse and skewed vectors: whole lists and many rows are never read; dense ones: rows are given up before their last terms."""
    rng = np.random.default_rng(1)
    sparse = (rng.integers(1, 60, (4000, 64)) * (rng.random((4000, 64)) < 0.05)).astype(np.int64)
    dense = np.floor(rng.normal(size=(4000, 64)) * 64).astype(np.int64)
    for rows, most in ((sparse, 0.6), (dense, 0.9)):
        post, total = maxscore.Postings(rows, np.float64), 0
        for i in range(40):
            q = rows[i].astype(np.float64)
            place, score, read = maxscore.query_topk(post, q, np.array([i]), 20)
            want = sorted((-int(s), k) for k, s in enumerate(rows @ rows[i]) if k != i)[:20]
            assert list(zip((-score).astype(int).tolist(), place.tolist(), strict=True)) == want
            at_least, *_ = maxscore.query_topk(post, q, np.array([i]), 20, theta=score[-1])
            assert list(at_least) == list(place)
            total += read
        assert total < most * 40 * rows.size


def brute_substring(rows, span):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - span + 1):
                key = tuple(w[k : k + span])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if i is not None and first[tuple(w[k : k + span])] < i:
                gone[k : k + span] = [True] * span
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring(spark, odd_docs):
    r = random.Random(9)
    shared = [prose(s, 90) for s in range(6)]
    rows = [(i, " ".join(x for _ in range(3) for x in (prose(1000 + i, r.randrange(5, 60)), r.choice(shared)[r.randrange(30) :]))) for i in range(60)]
    rows += [(200 + i, prose(3, 300).replace(" ", f" w{i} ", 1 + i)) for i in range(5)] + [(300, "same " * 400), (301, "same " * 300), (302, "same　\n" * 90)]
    rows += [(i if i is None else i + 1000, t) for i, t in odd_docs] + [(5, rows[5][1]), (2, rows[40][1])]
    for span, phrase in ((50, 12), (10, 3)):
        df = docs_of(spark, rows).repartition(3)
        got = substring.remove_repeats(df, span=span, phrase=phrase, with_text=True, carry=("score", "lang"), bucket_bytes=2000).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got), key=str) == brute_substring(rows, span)
        assert all(hashlib.sha256(x.kept.encode()).hexdigest() == x.kept_sha256 and x.score == "z" and x.lang is None for x in got)
        assert all(sum(s.stop - s.start for s in x.removed) == x.n_removed for x in got)
    assert substring.remove_repeats(docs_of(spark, [])).count() == 0


def test_substring_with_hot_lines_and_string_ids(spark, monkeypatch):
    """One 20-word line in every document, one passage in a third of them: phrases, runs and windows with a hot key, all dealt."""
    from factlens.llm import common

    monkeypatch.setattr(common, "ONE_TASK", 0)
    r = random.Random(3)
    line, passage = prose(90, 20), prose(91, 70)
    rows = [(f"d{i:03d}", " ".join([prose(500 + i, r.randrange(10, 90)), line, prose(900 + i, r.randrange(40)), passage if i % 3 == 0 else "", line])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = substring.remove_repeats(df, bucket_bytes=3000).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got), key=str) == brute_substring(rows, 50)


def test_the_automaton_locates_the_runs():
    """From the places of the named phrases alone, runs_at() gives the runs that the hashes of all windows give; without places, none."""
    texts = [prose(s, n, 60) for s, n in ((1, 300), (2, 55), (3, 49), (4, 700))] + ["same " * 200, "a b " * 90]
    words = [substring.words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words])
    flat = [w for x in words for w in x]
    want = substring.runs(flat, lengths)
    starts = np.cumsum(lengths) - lengths
    phrases = {int(h): b" ".join(words[d][a : a + substring.PHRASE]) for d, a, h in zip(want["doc"], want["at"], want["h"], strict=True)}
    locator = substring.Locator(list(phrases.values()))
    places = [locator.places(w) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(p) for p in places])
    assert len(owner) > len(want)  # every occurrence, also where no window names it
    got = substring.runs_at(substring.Hashes(flat), np.concatenate(places) + starts[owner], owner, lengths)
    key = lambda t: sorted(zip(t["doc"], t["h"], t["r"], strict=True))
    assert key(got) == key(want)
    assert not len(substring.runs_at(substring.Hashes(flat), np.empty(0, np.int64), np.empty(0, np.int64), lengths))


def test_substring_on_documents(spark, sf_dir):
    from factlens.llm.queries import op5_substring

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in op5_substring(spark, sf_dir).collect()), key=str) == brute_substring(rows, 50)


def test_media(spark, odd_docs, tmp_path):
    path = f"file://{tmp_path}/a"
    media.store_texts(docs_of(spark, odd_docs).repartition(3), path)
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.read_media(spark, path, rangeBytes=1500).collect()), key=str)
    want = []
    for i, t in odd_docs:
        raw = (t or "").encode()
        p = raw + b"\0" * ((-len(raw) % 64) if raw else 64)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert media.payload_of(media.png_of(p)) == p
    assert got == sorted(want, key=str)
    assert len({(r.media_sha256, r.feature) for r in media.read_media(spark, path).collect() if r.payload_sha256 == want[-1][3]}) == 1
    empty = f"file://{tmp_path}/b"
    media.store_texts(docs_of(spark, []), empty)
    assert media.read_media(spark, empty).count() == 0


def test_media_retries_a_member_and_reads_foreign_archives(spark, tmp_path, monkeypatch):
    import io
    import tarfile

    png = media.png_of(b"\x07" * 128)
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        for name, data in (("k1-128", png), ("k2-128", png[:-20] + b"broken" + png[-14:])):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    media.register(spark)
    rows = spark.read.format("tararchive").option("path", f"file://{tmp_path}").option("onError", "null").option("retries", 1).load().collect()
    assert sorted((r.key or "", r.media is None, r.error is None) for r in rows) == [("", True, False), ("1-128", False, True)]

    got = media.read_media(spark, f"file://{tmp_path}", "string", onError="null", retries=0).collect()
    assert sorted((r.n_bytes or 0, r.error is None) for r in got) == [(0, False), (128, True)]  # the failed member has a row

    class Flaky:
        """A file system whose opens and reads fail the first time each."""

        opens, reads = 0, set()

        def open_input_file(self, name):
            Flaky.opens += 1
            if Flaky.opens == 1:
                raise OSError("lost")
            f = open(name, "rb")
            outer = self

            class File:
                def seek(self, at):
                    self.at = at
                    f.seek(at)

                def read(self, n):
                    if (at := f.tell()) not in outer.reads:
                        outer.reads.add(at)
                        raise OSError("lost")
                    return f.read(n)

                def size(self):
                    return (tmp_path / "y.tar").stat().st_size

            return File()

    with tarfile.open(tmp_path / "y.tar", "w") as t:
        for k in range(4):
            info = tarfile.TarInfo("k" + "n" * 40 * k)
            info.size = len(png)
            t.addfile(info, io.BytesIO(png))
    (tmp_path / "x.tar").unlink()
    monkeypatch.setattr(media, "filesystem", lambda uri: (Flaky(), str(tmp_path)))
    monkeypatch.setattr(media, "read_manifest", lambda path: [{"file": "y.tar", "size": (tmp_path / "y.tar").stat().st_size, "index": -1, "members": -1}])
    reader = media._Reader("x", 1 << 20, 1 << 20, 9, "fail")
    batches = list(reader.read(reader.partitions()[0]))
    assert [k for b in batches for k in b.column(0).to_pylist()] == ["n" * 40 * k for k in range(4)] and Flaky.opens > 5
    Flaky.opens, Flaky.reads = 0, set()
    with pytest.raises(OSError):
        list(media._Reader("x", 1 << 20, 1 << 20, 0, "fail").read(reader.partitions()[0]))


def test_media_long_names_and_ranges(spark, tmp_path, monkeypatch):
    rows = [(f"id-{'é' * k}", prose(k, 3 + k)) for k in range(120)] + [("", "x"), (None, "y"), ("=", "z")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    path = f"file://{tmp_path}/long"
    media.store_texts(df, path)
    want = sorted(((i, len(t.encode())) for i, t in rows), key=str)
    for size in (700, 5000, 1 << 20):
        assert sorted(((r.doc_id, r.n_bytes) for r in media.read_media(spark, path, "string", rangeBytes=size).collect()), key=str) == want
    import tarfile

    for x in media.read_manifest(path):
        with tarfile.open(tmp_path / "long" / x["file"]) as t:  # any tar reader reads them
            assert len(t.getnames()) == x["members"] + 1


def test_sharding(spark, odd_docs):
    rows = [*odd_docs, *((7, prose(s, 5)) for s in range(200)), *((None, "n") for _ in range(50))]
    for parts in (1, 5):
        got = sharding.shard_by_bytes(docs_of(spark, rows).repartition(4), 16, partitions=parts).collect()
        assert len(got) == len(rows)
        got.sort(key=lambda r: r.row_index)
        at = 0
        for r in got:
            assert r.byte_start == at
            at += r.size
        assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(i if i is not None else -1 for i, _ in rows)
        size = {}
        for s, group in itertools.groupby(got, key=lambda r: r.shard):
            group = list(group)
            assert [r.slot for r in group] == list(range(len(group))) and s not in size
            size[s] = sum(r.size for r in group)
        assert all(abs(v - at / 16) <= max(r.size for r in got) for v in size.values())
        assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sharding.shard_by_bytes(docs_of(spark, [])).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 61, 1000, 70_000):
        for top in (1, 2, 100, 50_000, 2**40, 2**64 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            if n > 500:
                ids[100:450] = 0
            assert (simple8b.decode_block(simple8b.encode_block(ids), n) == ids).all()
    ids = rng.integers(0, 2, 6000, dtype=np.uint64)
    assert len(simple8b.encode_block(ids)) <= 101


def test_token_files(spark, odd_docs):
    odd_docs = [*odd_docs, *((105, prose(s, 7 + s)) for s in range(9))]  # one id, several texts
    seen = []
    for dealt in (2, 3):
        got = simple8b.encode_and_read(docs_of(spark, odd_docs).repartition(dealt + 1), vocabulary_path(WORD), partitions=dealt).orderBy("start").collect()
        start = 0
        assert [r.doc_id for r in got] == sorted((i for i, _ in odd_docs), key=lambda i: (i is not None, i or 0))
        for r in got:
            assert r.start == start
            start += r.n_tokens
        want = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((i, [*ids_by_library(WORD, t), 1]) for i, t in odd_docs)]
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
        seen.append([tuple(r) for r in got])
    assert seen[0] == seen[1]  # also the order of rows that share an id
    named = spark.createDataFrame([("b", "x y"), (None, "z"), ("", None), ("aé", "y")], "doc_id string, text string")
    assert [r.doc_id for r in simple8b.encode_and_read(named, vocabulary_path(WORD), partitions=2).orderBy("start").collect()] == [None, "", "aé", "b"]
    assert simple8b.encode_and_read(docs_of(spark, []), vocabulary_path(WORD)).count() == 0


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(4)
    for n in (0, 1, 5, 40, 90, 150):
        for rate in (0.0, 0.03, 0.15, 0.6):
            a = [r.randrange(30) for _ in range(n)]
            b = [x for y in a for x in (([] if r.random() < 0.5 else [y, r.randrange(30)]) if r.random() < rate else [y])]
            d = brute_distance(a, b)
            for most in (0, 3, 10, 30, 200):
                x, y = np.array(a, np.uint64), np.array(b, np.uint64)
                got = near.edit_distance(x, y, most)
                assert d <= got <= most if d <= most else got > most, (n, rate, d, most, got)
                assert near._banded(x, y, most) == min(d, most + 1)


def test_edit_distance_of_long_texts_takes_time_by_the_edits():
    import time

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 40, 300_000).astype(np.uint64)
    b = a.copy()
    b[rng.choice(len(a), 50_000, replace=False)] = 7
    c = rng.permutation(a[:50_000])
    began = time.time()
    assert near.edit_distance(a, b, 60_000) == 50_000
    assert near.edit_distance(a, b, 40_000) > 40_000
    assert near.edit_distance(a[:50_000], c, 10_000) > 10_000
    assert time.time() - began < 60


def test_near_recall_at_its_own_similarity(spark):
    """Texts with words replaced, inserted and dropped, all of which the alignment accepts: at least 0.9 of the pairs become one class."""
    r = random.Random(31)
    rows, pairs = [], {}
    for share in (0.10, 0.15, 0.19):
        for _ in range(150):
            words = [f"w{r.randrange(4000)}" for _ in range(r.randrange(60, 500))]
            out = list(words)
            for k in sorted(r.sample(range(len(words)), int(share * len(words))), reverse=True):
                what = r.random()
                out[k : k + 1] = [f"n{r.randrange(10**6)}"] if what < 0.6 else [] if what < 0.8 else [out[k], f"n{r.randrange(10**6)}"]
            i = len(rows)
            if near.similar(" ".join(words), " ".join(out)):
                rows += [(i, " ".join(words)), (i + 1, " ".join(out))]
                pairs.setdefault(share, []).append(i)
    label = {x.doc_id: x.class_id for x in near.near_duplicate_classes(docs_of(spark, rows)).collect()}
    for share, firsts in pairs.items():
        assert len(firsts) > 100 and sum(label[i] == label[i + 1] for i in firsts) >= 0.9 * len(firsts), share
    assert all(c // 2 == i // 2 for i, c in label.items())


def test_near_ids_of_any_type_and_hot_groups(spark, monkeypatch):
    from factlens.llm import common

    monkeypatch.setattr(common, "ONE_TASK", 0)  # every join is dealt
    base = prose(77, 120)
    r = random.Random(5)
    rows = [(f"id{i:04d}", changed(base, r, 0.02)) for i in range(60)] + [(f"id{i:04d}", base) for i in range(60, 90)] + [(f"x{i}", prose(300 + i, 80)) for i in range(20)] + [(None, base), ("e", ""), ("x3", prose(303, 80))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = near.near_duplicate_classes(df).collect()
    assert len(got) == len(rows)
    assert {x.class_id for x in got if (x.doc_id or "").startswith("id")} == {"id0000"}
    assert all(x.class_id == x.doc_id for x in got if not (x.doc_id or "").startswith("id"))


def changed(text, r, share):
    w = text.split()
    for k in r.sample(range(len(w)), max(1, int(share * len(w)))):
        w[k] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark, odd_docs):
    r = random.Random(8)
    rows = [(i, prose(5000 + i, 60 + i)) for i in range(80)]
    copies = {i: [200 + 10 * i + k for k in range(4)] for i in range(0, 80, 8)}
    for i, ids in copies.items():
        rows += [(ids[0], rows[i][1]), (ids[1], "  " + rows[i][1].replace(" ", "\n")), (ids[2], changed(rows[i][1], r, 0.01)), (ids[3], changed(rows[i][1], r, 0.03))]
    rows += [(5000 + k, changed(rows[3][1], r, 0.01)) for k in range(150)] + [(i if i is None else i + 9000, t) for i, t in odd_docs]
    got = {}
    for x in near.near_duplicate_classes(docs_of(spark, rows).repartition(3)).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, got.values())) == len(rows)
    assert len(got[None]) == 1 and got[None][0].class_id is None
    for i in range(80):
        for k in copies.get(i, []):
            assert got[k][0].class_id == got[i][0].class_id == i
        assert got[i][0].class_id == i
    assert {got[5000 + k][0].class_id for k in range(150)} == {3}
    assert got[9103][0].class_id == got[9104][0].class_id == 9103 and got[9104][0].is_copy and len(got[9103]) == 2
    assert got[9100][0].class_id == 9100 and got[9101][0].class_id == 9101
    assert near.near_duplicate_classes(docs_of(spark, [])).count() == 0


def test_near_finds_what_brute_force_finds(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, (t or "").split()) for i, t in rows)}
    label = {r.doc_id: r.class_id for r in near.near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for a, b in itertools.combinations(shingles, 2):
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) and len(shingles[a]) > 1:
            assert label[a] == label[b]
    text = dict(rows)
    for i, c in label.items():
        if i != c:
            assert any(label[j] == c and j != i and near.similar(text[i], text[j]) for j in text)


def crowd(n, of):
    """Copies of one text with many words changed, and other texts that have boilerplate in common and two copies each."""
    r = random.Random(12)
    base, plate = prose(70, 200), prose(71, 60)
    rows = [(i, changed(base, r, r.uniform(0.05, 0.12))) for i in range(n)]
    for k in range(of):
        own = plate + " " + prose(8000 + k, 60, 4000)
        rows += [(n + 3 * k + j, changed(own, r, 0.04 + 0.03 * j)) for j in range(3)]
    return rows


def test_near_tests_all_pairs_of_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(near, "SIDE", 20)
    rows = crowd(160, 60)
    words = {i: near.word_hashes(t.split()) for i, t in rows}
    sketch = {i: near.order_minhash(h) for i, h in words.items()}
    want = {i: i for i, _ in rows}
    for a, b in itertools.combinations(want, 2):
        if want[a] != want[b] and len(np.intersect1d(sketch[a], sketch[b])) and near.similar(rows[a][1], rows[b][1]):
            low, high = sorted((want[a], want[b]))
            want = {i: low if c == high else c for i, c in want.items()}
    got = {x.doc_id: x.class_id for x in near.near_duplicate_classes(docs_of(spark, rows)).collect()}
    assert got == want


def test_near_blocks_keep_every_pair():
    import pandas as pd

    rows = crowd(60, 20)
    sketch = [near.order_minhash(near.word_hashes(t.split())) for _, t in rows]
    bags = next(near._bagger(iter([pd.DataFrame(rows, columns=["node", "text"])])))
    bags = bags.assign(label=bags["node"] // 4, block=bags["node"] % 3)
    for bucket in sorted({int(k) for s in sketch for k in s})[::7]:
        part, got = bags[[bucket in s for s in sketch]], []
        for lo, hi in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
            some = part[part["block"].isin((lo, hi))]
            if len(some):
                x = near._crosser(0.8, 1000)(some.assign(lo=lo, hi=hi))
                assert not x["more"].any()
                got += x[["a", "b"]].itertuples(index=False, name=None)
                one = near._crosser(0.8, 1)(some.assign(lo=lo, hi=hi))
                classes = [tuple(sorted((a // 4, b // 4))) for a, b in zip(x["a"], x["b"], strict=True)]
                assert {tuple(sorted((a // 4, b // 4))): m for a, b, m in one[["a", "b", "more"]].itertuples(index=False)} == {c: classes.count(c) > 1 for c in classes}
        assert len(got) == len(set(got))
        for a, b in itertools.combinations(sorted(part["node"]), 2):
            if a // 4 != b // 4 and near.similar(rows[a][1], rows[b][1]):
                assert (b, a) in got


def test_pieces(spark, odd_docs):
    import sentencepiece

    path = vocabulary_path(PIECE)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df = docs_of(spark, odd_docs).repartition(2)
    got = pieces.encode_documents(df, path, with_ids=True)
    rows = got.collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=str) == sorted(((i, sp.encode(t or "")) for i, t in odd_docs), key=str)
    marked = {i for i, t in odd_docs if "▁" in (t or "")}  # the library cannot tell these from blanks
    assert all(r.round_trip == (r.doc_id not in marked) for r in rows)
    assert all(r.parity and r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    back = pieces.decode_documents(got, path).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, (t or "").replace("▁", " ")) for i, t in odd_docs), key=str)
    assert pieces.encode_documents(docs_of(spark, []), path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_of_latin_letters_are_those_of_texts(name):
    from factlens.llm.tokens import ChunkEncoder

    letters = [chr(i) for i in range(32, 0x250)]
    texts = ["İstanbul ǅ ſ ß ẞ İ,", "ŉ ΑΣ.", " ".join(letters), " ".join(x * 3 + "," for x in letters), " ".join("a" + x + "B." for x in letters)]
    c = ChunkEncoder(vocabulary_path(name))
    assert c.encode(texts) == c._ids(texts)


def test_pieces_of_words_are_those_of_texts():
    c, rng = pieces.Codec(vocabulary_path(PIECE)), random.Random(1)
    texts = ["a\nb", "a\n", "a\n\nb", "a\n b", "\na", "a \nb", "\n", "é\n漢\n字 b", "a\t\nb", "\x00\nb", "a\r\nb"]
    texts += ["".join(rng.choice(["a", " ", "\n", "th", "▁", "漢", ".", " "]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    assert c.by_word and c.by_line
    assert c.encode(texts) == c._both(texts) and all(same for _, same in c._both(texts))


def test_pieces_count_words_that_the_libraries_encode_apart():
    c = pieces.Codec(vocabulary_path(PIECE))
    true, c.sp = c.sp, None

    class Other:
        def encode(self, texts, num_threads=1):
            return [ids + [0] * ("wrong" in t) for t, ids in zip(texts, true.encode(texts), strict=True)]

    c.sp = Other()
    assert [same for _, same in c.encode(["one two", "one wrong", "two\none", "a\nwrong"])] == [True, False, True, False]


def test_unigram_model_is_rebuilt():
    spec = pieces.Spec([("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("▁ab", -2.2, 1), ("a", -3.0, 1), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))], 1, True, 0, b"", True, True, True)
    tok = pieces.build(spec)
    assert tok.encode("ab  a", add_special_tokens=False).tokens == ["▁ab", "▁a"]
    assert tok.decode(tok.encode("é ab", add_special_tokens=False).ids, skip_special_tokens=False) == "é ab"


def test_queries_give_the_rows_of_their_sql(spark, sf_dir):
    import duckdb

    from factlens.llm import queries

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        columns = sorted(df.columns)
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == columns
        assert sorted(tuple(x[k] for k in columns) for x in df.collect()) == sorted(tuple(x[names.index(k)] for k in columns) for x in r.fetchall()), name


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    left = p.STAGES[0][1](spark, docs, sf_dir)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, s in scores.items() if s < 0.7}
    one = p.STAGES[1][1](spark, left, sf_dir)
    label = {r.doc_id: r.class_id for r in near.near_duplicate_classes(left).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(label.values()))
    cut = p.STAGES[2][1](spark, one, sf_dir)
    want = {i: h for i, _, _, h in brute_substring([(r.doc_id, r.text) for r in one.collect()], 50)}
    assert cut.columns == docs.columns and {r.doc_id: hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).encode()).hexdigest() for r in cut.collect()} == want
    assert all(r.text == texts[r.doc_id] for r in cut.join(one.select("doc_id", "text"), ["doc_id", "text"], "left_semi").collect())
    out = p.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(want)


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd_docs):
    import corpus_pipeline as p

    for rows in (odd_docs, []):
        df = docs_of(spark, rows)
        for name, stage in p.STAGES[:-1]:
            df = stage(spark, df, sf_dir)
            assert df.columns == docs_of(spark, []).columns and df.dtypes == docs_of(spark, []).dtypes, name
        n = p.STAGES[-1][1](spark, df, sf_dir).count()
        assert (n > 0) == bool(rows)
