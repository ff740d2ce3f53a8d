"""Every query with SQL gives DuckDB's rows; the rest run; invariants of splits and text rules."""

import decimal

import duckdb
import pytest

from factlens.catalog import QUERIES, SQL
from factlens.functions import text as T
from factlens.operators import examples, mining, ranking, splits, stats
from factlens.sources import readers, writers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) and abs(v) < 1e15 else v
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=str)


def test_quota_and_split_invariants(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 997).select(F.concat(F.lit("r"), (F.col("id") % 7).cast("string")).alias("r"), "id")
    quotas = {x.r: x.quota for x in splits.largest_remainder(df.groupBy("r").agg(F.count("*").alias("n")), "r", "n", 500).collect()}
    assert sum(quotas.values()) == 500
    hands = [x["count"] for x in splits.round_robin(df, "r", "id", 1, ["a", "b", "c"]).groupBy("hand").count().collect()]
    assert max(hands) - min(hands) <= 1 and sum(hands) == 997
    parts = splits.stratified_split(df, "r", "id", 1)
    assert parts.count() == 997 and splits.shared_keys(parts, ["id"], "part").isEmpty()


def test_bootstrap_draws_as_often_as_the_survey_says():
    import inspect

    assert inspect.signature(stats.bootstrap_difference).parameters["replicates"].default == 10_000


def test_mcnemar_matches_exact_binomials(spark):
    import math

    df = spark.createDataFrame([(0, 0), (1, 9), (40, 61), (700, 800)], "b long, c long")
    for r in df.select("b", "c", stats.mcnemar_p(df.b, df.c).alias("p")).collect():
        n, k = r.b + r.c, min(r.b, r.c)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert abs(r.p - want) <= 1e-9 * want


def test_text_rules(spark):
    from pyspark.sql import functions as F

    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(T.set_masks(F.lit("a [MASK] [MASK]  [MASK] b [MASK]"), F.lit(2))) == "a [MASK] [MASK] b [MASK]"
    assert one(T.merge_subwords(F.array(*[F.lit(x) for x in ("un", "##do", "##ing", "it")]))) == ["undoing:3", "it:1"]
    assert one(T.is_latin(F.lit("Ünï 12"))) and one(T.is_latin(F.lit("abc жук"))) and not one(T.is_latin(F.lit("12 жук ª")))
    ends = {"[Y].": True, "[a;Y;b] \t.": True, "[X] to [Y].": True, "in [Y].": False, "[Y]": False, "[X].": False, "": False, "[Y]!": False}
    assert {p: one(T.ends_in_object(F.lit(p))) for p in ends} == ends
    assert one(T.gold_match(F.lit("Paris ."), F.array(F.lit("x"), F.lit("PARIS"))))
    assert one(T.mention_fill(F.lit("[[a]] in [[b]]."), F.array(F.lit("X"), F.lit("Y")))) == "X in Y."
    assert one(T.malformed_inflection(F.lit("abcdef gh"), F.lit("abcxx gh"))) is False and one(T.malformed_inflection(F.lit("abc"), F.lit("xbc"))) is True
    assert one(T.malformed_inflection(F.lit("abcdef"), F.lit("abcxyzuvw"))) is True and one(T.malformed_inflection(F.lit("Moscow"), F.lit("moscóws"))) is False
    assert one(T.malformed_inflection(F.lit("a  b"), F.lit("A  c"))) is True and one(T.malformed_inflection(F.lit("ёж"), F.lit("ежами"))) is False
    label = lambda g, r, s: one(T.error_label(T.comparable(F.lit(g)), T.comparable(F.lit(r)), T.comparable(F.lit(s))))
    got = [label(*x) for x in (("Paris", "x", "Lyon"), ("New York", "x", "new york city"), ("x y", "LYON!", "Lyon"), (". a", "Lyon", "Lyon"), (None, "a", "b"), ("ab", "", None), ("ＰＡＲＩＳ", "", "paris"))]
    assert got == ["", "subject_repetition", "subject_repetition", "non_informative", "non_informative", "", "subject_repetition"]
    assert one(T.strip_accents(F.lit("ёé"))) == "еe" and one(T.normalize("NFC")(F.lit("é"))) == "é" and one(T.casefold(F.lit("Straße"))) == "strasse"
    claimed = one(mining.claim_positions(F.array(*[F.struct(F.lit(e).alias("ent"), F.lit(a).alias("begin"), F.lit(b).alias("end")) for e, a, b in (("x", 0, 3), ("y", 2, 4), ("z", 3, 5))])))
    assert [m.ent for m in claimed] == ["x", "z"]
    assert one(mining.char_offsets(F.array(*[F.lit(x) for x in ("ab", "c", "def")]))) == [0, 3, 5]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "facts").mkdir()
    (tmp_path / "facts/P1.jsonl").write_text('{"predicate_id":"P1","sub_uri":"Q2","obj_uri":"Q10","sub_label":"a"}\n\n{"predicate_id":"P1","sub_uri":"Q3","obj_uri":null}\n')
    got = readers.facts(spark, f"{tmp_path}/facts").orderBy("sub_uri").collect()
    assert [(r.relation, r.sub_uri, r.obj_uri) for r in got] == [("P1", "Q2", "Q10"), ("P1", "Q3", None)]
    (tmp_path / "facts/P2.jsonl").write_text('{"sub_uri":"Q2"}\n')
    with pytest.raises(Exception, match="invalid fact"):
        readers.facts(spark, f"{tmp_path}/facts").collect()
    assert readers.facts(spark, f"{tmp_path}/facts", strict=False).count() == 3
    (tmp_path / "labels.txt").write_text('Q10\t"ten"@en\t"tien"@nl\t"TEN"@en\nQ2\t"a@b"@en\tbroken\n\n')
    labels = readers.labels(spark, f"{tmp_path}/labels.txt")
    assert sorted((r.entity, r.lang or "", r.label or "", r.malformed) for r in labels.collect()) == [("Q10", "en", "TEN", False), ("Q10", "nl", "tien", False), ("Q2", "", "", True), ("Q2", "en", "a@b", False)]
    writers.label_file(labels.where("NOT malformed"), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ['Q2\t"a@b"@en', 'Q10\t"TEN"@en\t"tien"@nl']
    (tmp_path / "t.csv").write_text("pid,en,nl\nP1,[X] is [Y] .,\nP2,a,b\n")
    assert readers.templates(spark, f"{tmp_path}/t.csv", ["en", "nl"]).count() == 3
    with pytest.raises(ValueError, match="ru"):
        readers.templates(spark, f"{tmp_path}/t.csv", ["ru"])
    df = spark.createDataFrame([("train", "P1", "Q1", "Q2"), ("test", "P1", "Q3", "Q4")], "part string, relation string, sub_uri string, obj_uri string")
    (tmp_path / "split.json").write_text(writers.split_manifest(df).first().value)
    assert sorted(map(tuple, readers.split_manifest(spark, f"{tmp_path}/split.json").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "bad.json").write_text('{"train":[["P","a","b"]],"val":[["P","a","b"]],"test":[]}')
    with pytest.raises(Exception, match="in two parts"):
        readers.split_manifest(spark, f"{tmp_path}/bad.json").collect()
    assert readers.csv_or_empty(spark, f"{tmp_path}/none.csv", "a int").count() == 0
    (tmp_path / "l.txt").write_text("x\ny\n\nz\n")
    assert [(r.line_id, r.value) for r in readers.lines(spark, f"{tmp_path}/l.txt").collect()] == [(0, "x"), (1, "y"), (2, ""), (3, "z")]


def test_rendering_edges(spark):
    from factlens.functions import languages as L

    rows = [("[DEF;X] [X.Gen] [Y]", None, None, None), ("[X] [X] [DEF;X]", "", "female", "city"), (None, "Πάρος", "male", None), ("", "Πάρος", "male", None), ("[PREPDEF;X] [X]", "Πάρος", "male", None)]
    df = spark.createDataFrame(rows, "p string, l string, s string, k string")
    got = [r.text for r in L.fill_role(df, "el", "x", "p", "l", sex="s", instance="k").collect()]
    assert got[1:] == [" [X] η", None, "", "[PREPDEF;X] Πάρος"] and got[0].endswith("[Y]")
    masked = L.fill_role(df, "el", "x", "p", "l", sex="s", masks=2, articles=False).collect()
    assert masked[1].text == "[MASK] [MASK] [X] " and masked[1].filled == ""
    assert L.fill_role(spark.createDataFrame([("[X] x", "a")], "p string, l string"), "vi", "x", "p", "l").first().text == "a x"
    none = L.fill_role(spark.createDataFrame([], "p string, l string"), "fr", "y", "p", "l")
    assert none.columns == ["p", "l", "text", "filled"] and none.isEmpty()


def test_russian_template_without_slot_raises(spark):
    from factlens.functions import languages as L

    with pytest.raises(Exception, match="no X in"):
        L.fill_role(spark.createDataFrame([("x", "a")], "p string, l string"), "ru", "x", "p", "l").collect()


def test_more_formats(spark, tmp_path):
    w = lambda name, text: (tmp_path / name).parent.mkdir(parents=True, exist_ok=True) or (tmp_path / name).write_text(text, encoding="utf-8")
    w("cate.txt", "Q1\t1\nQ2\t0\n\n")
    assert {r.entity: r.is_category for r in readers.categories(spark, f"{tmp_path}/cate.txt").collect()} == {"Q1": True, "Q2": False}
    w("rel.jsonl", '{"relation":"P1","type":"N-1"}\n{"relation":"P1","type":"N-M","template":"t"}\n')
    assert [(r.relation, r.type, r.template) for r in readers.relations(spark, f"{tmp_path}/rel.jsonl").collect()] == [("P1", "N-M", "t")]
    w("langs.csv", "pid,en,nl\nP1,a,b\n")
    assert readers.languages_of(spark, f"{tmp_path}/langs.csv") == ["en", "nl"]
    w("t.tsv", "rel\tl\td\tt\ttemplate\nP1\tborn\tis \"x\tN-1\t[X] in [Y]\n")
    assert readers.template_table(spark, f"{tmp_path}/t.tsv").first().template == "[X] in [Y]"
    w("prompts/P1.jsonl", "".join('{"template":"%d"}\n' % i for i in range(60)))
    got = readers.extra_prompts(spark, f"{tmp_path}/prompts")
    assert got.count() == 50 and {r.relation for r in got.collect()} == {"P1"} and got.where("nth = 49").first().template == "49"
    w("some.json", '{"a":[["P1","Q1","Q2"],["Q3","Q4"]],"b":[["x"]]}')
    assert sorted(map(tuple, readers.restricted_facts(spark, f"{tmp_path}/some.json", "a").collect()), key=str) == [("P1", "Q1", "Q2"), (None, "Q3", "Q4")]
    with pytest.raises(Exception, match="two or three"):
        readers.restricted_facts(spark, f"{tmp_path}/some.json", "b").collect()
    w("m/r/seed2/history_1.json", '[{"epoch":1,"val_loss_by_lang":{"en":1.5,"nl":2.0},"train_loss_by_lang":{"en":1.0}}]')
    got = {r.lang: r for r in readers.histories(spark, f"{tmp_path}/m/r/seed2/history_1.json").collect()}
    assert got["nl"].train_loss is None and got["en"].train_loss == 1.0 and (got["en"].model, got["en"].run, got["en"].seed) == ("m", "r", 2)
    w("pred.csv", "a,is_same,is_same\n1,x,y\n")
    assert readers.prediction_table(spark, f"{tmp_path}/pred.csv").collect()[0].asDict() == {"a": "1", "is_same": "x", "is_same.1": "y"}
    w("switch.txt", "a b\tQ1 ||| x ||| y\tQ2 ||| z\nc\n")
    assert [(r.text, r.mentions) for r in readers.code_switched(spark, f"{tmp_path}/switch.txt").collect()] == [("a b", [["Q1", "x", "y"], ["Q2", "z"]]), ("c", [])]
    u = "http://x/"
    w("trex.json", '[{"docid":"d","triples":[{"subject":{"uri":"%sQ1","surfaceform":"s"},"predicate":{"uri":"%sP1"},"object":{"uri":"%sQ2","surfaceform":"o"}},{"subject":{"uri":"%sQ1"},"predicate":{"uri":"%sP2"},"object":{"uri":"2001"}}]}]' % (u, u, u, u, u))
    assert [(r.predicate, r.sub_uri, r.obj_form) for r in readers.triples(spark, f"{tmp_path}/trex.json").collect()] == [("P1", "Q1", "o")]
    df = spark.createDataFrame([("Q10", "b"), ("Q2", "z"), ("Q10", "a"), ("Q10", "a")], "e string, v string")
    read = lambda p: [line for f in sorted((tmp_path / p).glob("part-*")) for line in f.read_text(encoding="utf-8").splitlines()]
    writers.tail_file(df, f"{tmp_path}/tail", "e", "v")
    assert read("tail") == ["Q2\tz", "Q10\ta\tb"]
    writers.csv(df.coalesce(1), f"{tmp_path}/marked", mark=True)
    assert read("marked")[0] == "﻿e,v" and readers.annotations(spark, f"{tmp_path}/marked").columns == ["e", "v", "source_file"]
    writers.objects_file(spark.createDataFrame([("P2", "Q1", "Q9"), ("P1", "Q10", "Q3"), ("P1", "Q2", "Q5"), ("P1", "Q2", "Q4")], "r string, s string, o string"), f"{tmp_path}/objects", "r", "s", "o")
    assert read("objects") == ["Q2\tP1\tQ4 Q5", "Q10\tP1\tQ3", "Q1\tP2\tQ9"]
    writers.aligned_texts(spark.createDataFrame([(i, f"a{i}", None if i == 3 else f"b{i}") for i in range(20)], "i int, a string, b string"), f"{tmp_path}/five", ["a", "b"], ["i"])
    assert [x[1:] for x in read("five/a")] == [str(i) for i in range(20)] and [x[1:] for x in read("five/b")] == [str(i) if i != 3 else "" for i in range(20)]


def test_running_sums_in_groups_of_any_size(spark):
    import random

    from pyspark.sql import functions as F

    from factlens.operators.running import running

    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "a", "b", None]), i, r.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    out = running(df, ["k"], [F.col("i").desc()], {"n": F.lit(1), "s": F.col("v")}, {"s": "all"}).collect()
    want, total = {}, {}
    for k in ("a", "b", None):
        n = s = 0
        for _, i, v in sorted((x for x in rows if x[0] == k), key=lambda x: -x[1]):
            n, s = n + 1, s + v
            want[i] = (n, s)
        total[k] = s
    assert len(out) == 3000 and all(want[x.i] == (x.n, x.s) and x["all"] == total[x.k] for x in out)
    assert running(df.limit(0), ["k"], ["i"], {"n": F.lit(1)}).count() == 0


def test_redirects_of_any_length_and_loops(spark):
    from factlens.operators import resolve

    rows = [(i, i + 1) for i in range(100)] + [(500, 501), (501, 502), (502, 500), (600, 500), (700, 700), (800, 900), (800, 850), (None, 1), (2000, None)]
    red = spark.createDataFrame(rows, "source long, target long")
    got = {r.k: (r.target, r.reason) for r in resolve.resolve_redirects(spark.createDataFrame([(k,) for k in (0, 37, 100, 500, 600, 700, 800, 5, 2000)], "k long"), red, "k").collect()}
    assert got == {0: (100, None), 37: (100, None), 100: (100, None), 500: (500, "loop"), 600: (600, "loop"), 700: (700, "loop"), 800: (850, None), 5: (100, None), 2000: (2000, None)}
    assert resolve.resolve_redirects(red.select("source"), red.limit(0), "source").where("target IS NOT NULL").count() == len(rows) - 1


def test_greedy_selection_is_the_serial_rule(spark):
    import random

    r = random.Random(6)
    rows = [(r.choice(["p", "p", "p", "q", None]), r.randrange(12), r.choice([None, *range(12)]), r.randrange(200)) for _ in range(500)]
    df = spark.createDataFrame(rows, "path string, a int, b int, s int").repartition(5)
    key = lambda x: (-x[3], x[1], -1 if x[2] is None else x[2])
    for cap, limit in ((3, 1000), (5, 7)):
        want = []
        for p in {x[0] for x in rows}:
            used, kept = {}, 0
            for x in sorted((x for x in rows if x[0] == p), key=key):
                if kept < limit and all(used.get(e, 0) < cap for e in x[1:3]):
                    kept += 1
                    want.append(x)
                    for e in x[1:3]:
                        used[e] = used.get(e, 0) + 1
        got = [tuple(x) for x in mining.greedy_capped(df, "path", ["a", "b"], "s", cap, limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert mining.greedy_capped(df.limit(0), "path", ["a", "b"], "s", 3, 5).count() == 0


def test_readers_of_exact_fields(spark, tmp_path):
    (tmp_path / "o.tsv").write_text('Q1\tP1\tQ5 Q6\nQ2\tP1\t"Q7\n\nQ1\tP1\tQ8\n')
    assert sorted((x.sub, x.objs) for x in readers.objects(spark, f"{tmp_path}/o.tsv").collect()) == [("Q1", ["Q8"]), ("Q2", ['"Q7'])]
    (tmp_path / "g.tsv").write_text('"Q1\t Male\nQ2\tx"\n')
    assert sorted(map(tuple, readers.genders(spark, f"{tmp_path}/g.tsv").collect())) == [('"Q1', "male"), ("Q2", "none")]
    (tmp_path / "g.tsv").write_text("Q1\tmale\tmore\n")
    with pytest.raises(Exception, match="not 2 fields"):
        readers.genders(spark, f"{tmp_path}/g.tsv").collect()


def test_lines_are_numbered_over_byte_ranges(spark, tmp_path):
    """Files cut into ranges far shorter than they are, with blank lines, long ones, all line ends, no last end, and no bytes at all."""
    (tmp_path / "t").mkdir()
    texts = {"a": "".join(f"line {i} {'x' * (i % 70)}\n" for i in range(500)), "b": "one\r\n\r\ntwo\r\nthree", "c": "", "d": "\n\n\n", "e": "y" * 5000 + "\nz\n"}
    for name, text in texts.items():
        (tmp_path / "t" / f"{name}.txt").write_bytes(text.encode())
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(f"{tmp_path}/t/a.txt").select("_metadata.file_block_start").distinct().count() > 10
        rows = readers.lines(spark, f"{tmp_path}/t").collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    got = {n: sorted((r.line_id, r.value) for r in rows if r.file.endswith(f"/{n}.txt")) for n in texts}
    assert got == {n: [(i, line.rstrip("\r\n")) for i, line in enumerate(open(tmp_path / "t" / f"{n}.txt", encoding="utf-8"))] for n in texts}


def serial_beam(rows, width):
    kept = {e: [((), 0)] for e, p, _, t, s in rows if None not in (e, p, t, s)}
    for p in sorted({r[1] for r in rows if r[1] is not None and None not in (r[0], r[3], r[4])}):
        for e, sequences in kept.items():
            new = {}
            for tokens, score in sequences:
                follow = [(tokens + (t,), score + s) for f, q, prev, t, s in rows if f == e and q == p and prev == (tokens[-1] if tokens else None) and t is not None and s is not None]
                for x, y in follow or [(tokens, score)]:
                    new[x] = max(new.get(x, y), y)
            kept[e] = sorted(new.items(), key=lambda x: (-x[1], x[0]))[:width]
    return {(e, i + 1, t, s) for e, sequences in kept.items() for i, (t, s) in enumerate(sequences)}


@pytest.mark.parametrize("width", [1, 2, 1000])
def test_beam_equals_serial_rule(spark, width):
    """Ties, repeated rows, gaps in the positions, sequences that end early, nulls; a width over all sequences gives every one."""
    import random

    r = random.Random(width)
    rows = [(e, p, prev, t, r.randrange(4)) for e in range(6) for p in (1, 2, 4) for prev in ([None] if p == 1 else "abc") for t in "abc" if r.random() < 0.7]
    rows += rows[:5] + [(0, 1, None, "a", 9), (None, 1, None, "a", 1), (7, None, None, "a", 1), (8, 1, None, None, 1), (9, 1, None, "b", None), (10, 2, "a", "b", 5)]
    x = spark.createDataFrame([(*row, "z") for row in rows], "example int, position int, prev string, token string, score long, tokens string")
    got = ranking.beam(x, width).collect()
    assert {(g.example, g["rank"], tuple(g.tokens), g.score) for g in got} == serial_beam(rows, width) and len(got) == len(serial_beam(rows, width))
    assert ranking.beam(x.limit(0), width).count() == 0


def test_masking_rates_and_edges(spark):
    """Shares of a large draw, the mentions' own rate, tokens that are never drawn, the same result again, and null or empty rows."""
    x = spark.range(400).selectExpr("id", "transform(sequence(0, 99), i -> if(i = 0, 1, 1000 + i)) AS tokens", "transform(sequence(0, 49), i -> i >= 25) AS named")
    run = lambda: [(r.id, r.tokens, r.inputs, r.labels) for r in examples.masked_tokens(x, ["id"], "tokens", 3, 0.15, 2, 900, mentions="named", mention_rate=0.4, never=(1,)).orderBy("id").collect()]
    rows = run()
    assert rows == run()
    hit = [(i, t, new) for _, tokens, inputs, labels in rows for i, (t, new, y) in enumerate(zip(tokens, inputs, labels, strict=True)) if y != -100 and y == t]
    assert all(new == t or y == t for _, tokens, inputs, labels in rows for t, new, y in zip(tokens, inputs, labels, strict=True)) and all(i for i, _, _ in hit)
    inside = sum(25 <= i < 50 for i, _, _ in hit)
    assert abs(inside / 10000 - 0.4) < 0.02 and abs((len(hit) - inside) / 29600 - 0.15) < 0.01
    kinds = [sum(new == 2 for *_, new in hit), sum(new == t for _, t, new in hit)]
    assert abs(kinds[0] / len(hit) - 0.8) < 0.02 and abs(kinds[1] / len(hit) - 0.1) < 0.02 and all(new < 900 for _, t, new in hit if new != t)
    edges = spark.createDataFrame([(1, None), (2, []), (None, [None, 5])], "id long, tokens array<int>")
    got = {r.id: (r.inputs, r.labels) for r in examples.masked_tokens(edges, ["id"], "tokens", 3, 1.0, 2, 900).collect()}
    assert got[1] == (None, None) and got[2] == ([], []) and got[None][0][0] is None and got[None][1] == [-100, 5]


def test_mcnemar_of_very_many_pairs(spark):
    """At 10^8 pairs the test is the normal one with its correction; nulls stay null."""
    import math

    half = 50_000_000
    df = spark.createDataFrame([(half - 10_000, half + 10_000), (half, half), (0, 100_000_000), (None, 3), (0, 0)], "b long, c long")
    got = [r.p for r in df.select(stats.mcnemar_p(df.b, df.c).alias("p")).collect()]
    assert abs(got[0] - math.erfc(19_999 / math.sqrt(2 * half) / math.sqrt(2))) < 1e-6
    assert got[1] == 1.0 and got[2] == 0.0 and got[3] is None and got[4] == 1.0
