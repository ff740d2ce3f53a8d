"""Resolution, mining and text-function queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining, resolve
from .base import query, r6, table

_LABELS = "labels_ AS (SELECT n_nationkey AS entity, CASE WHEN n_regionkey % 2 = 0 THEN 'en' ELSE 'nl' END AS lang, n_name AS label FROM nation)"
_FACTS = "facts AS (SELECT o_orderkey AS fact, o_orderstatus AS relation, o_custkey % 30 AS sub, o_orderkey % 25 AS obj FROM orders)"


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity"), F.when(F.col("n_regionkey") % 2 == 0, "en").otherwise("nl").alias("lang"), F.col("n_name").alias("label"))


def _facts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact"), F.col("o_orderstatus").alias("relation"), (F.col("o_custkey") % 30).alias("sub"), (F.col("o_orderkey") % 25).alias("obj"))


_JOINED = f"""{_LABELS}, {_FACTS}, wide AS (SELECT entity, max(label) FILTER (lang = 'en') AS en, max(label) FILTER (lang = 'nl') AS nl FROM labels_ GROUP BY entity),
j AS (SELECT f.*, s.en AS sub_en, s.nl AS sub_nl, o.en AS obj_en, o.nl AS obj_nl FROM facts f LEFT JOIN wide s ON f.sub = s.entity LEFT JOIN wide o ON f.obj = o.entity)"""


def _joined(spark, sf_dir):
    return resolve.with_labels(_facts(spark, sf_dir), _labels(spark, sf_dir), ["en", "nl"], "sub", "obj")


@query(f"WITH {_JOINED} SELECT * FROM j")
def j1_labels(spark, sf_dir):
    return _joined(spark, sf_dir)


@query(f"WITH {_JOINED} SELECT fact, sub_nl, obj_nl FROM j WHERE sub_nl IS NOT NULL AND obj_nl IS NOT NULL")
def p1_portion(spark, sf_dir):
    return resolve.portion(_joined(spark, sf_dir), "sub_nl", "obj_nl", "trans").select("fact", "sub_nl", "obj_nl")


@query(f"WITH {_JOINED} SELECT fact, coalesce(sub_nl, sub_en) AS sub_label, coalesce(obj_nl, obj_en) AS obj_label FROM j")
def p2_fallback(spark, sf_dir):
    return _joined(spark, sf_dir).select("fact", F.coalesce("sub_nl", "sub_en").alias("sub_label"), F.coalesce("obj_nl", "obj_en").alias("obj_label"))


@query(f"WITH {_JOINED} SELECT fact, CASE WHEN sub_nl IS NOT NULL AND obj_nl IS NOT NULL THEN sub_nl ELSE sub_en END AS sub_label, CASE WHEN sub_nl IS NOT NULL AND obj_nl IS NOT NULL THEN obj_nl ELSE obj_en END AS obj_label FROM j")
def p3_joint_fallback(spark, sf_dir):
    s, o = resolve.joint_fallback("sub_nl", "obj_nl", "sub_en", "obj_en")
    return _joined(spark, sf_dir).select("fact", s.alias("sub_label"), o.alias("obj_label"))


@query(f"WITH {_JOINED} SELECT fact, coalesce(nullif(sub_nl, ''), nullif(sub_en, ''), 'Q' || sub) AS sub_label FROM j")
def p4_three_level_fallback(spark, sf_dir):
    return _joined(spark, sf_dir).select("fact", resolve.fallback("sub_nl", "sub_en", F.concat(F.lit("Q"), F.col("sub").cast("string"))).alias("sub_label"))


@query("""WITH x AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders) SELECT o_orderkey FROM x
WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey % 50 = 0 AND p.o_orderstatus = x.o_orderstatus AND p.o_custkey = x.o_custkey) OR o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)""")
def p9_restricted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    return resolve.restricted(o, o.where("o_orderkey % 50 = 0"), o.where("o_totalprice > 300000"), "o_orderstatus", "o_custkey", "o_orderkey").select("o_orderkey")


@query(f"""WITH {_JOINED}, g AS (SELECT fact, obj_en AS gold FROM j UNION SELECT f.fact, l.label FROM facts f JOIN labels_ l ON l.entity = f.obj
UNION SELECT f.fact, l.label FROM facts f JOIN (SELECT DISTINCT relation, sub, obj FROM facts WHERE fact % 7 = 0) m ON f.relation = m.relation AND f.sub = m.sub JOIN labels_ l ON l.entity = m.obj)
SELECT fact, gold FROM g WHERE gold IS NOT NULL""")
def j4_j5_gold_answers(spark, sf_dir):
    facts = _joined(spark, sf_dir)
    objects = _facts(spark, sf_dir).where("fact % 7 = 0").select("relation", "sub", "obj").distinct()
    return resolve.gold_answers(facts, _labels(spark, sf_dir).select("entity", F.col("label").alias("alias")), objects, "fact", "relation", "sub", "obj", "obj_en")


@query(f"""WITH {_JOINED} SELECT relation, coalesce(CASE WHEN sub_nl IS NULL AND sub_en IS NULL THEN 'no subject' WHEN obj_nl IS NULL THEN 'no object' END, 'kept') AS reason, count(*) AS n FROM j GROUP BY ALL""")
def a63_load_reasons(spark, sf_dir):
    x = resolve.reasons(_joined(spark, sf_dir), [("no subject", F.col("sub_nl").isNull() & F.col("sub_en").isNull()), ("no object", F.col("obj_nl").isNull())])
    return x.groupBy("relation", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 20 IN (3, 7) THEN c_custkey + CASE c_custkey % 20 WHEN 3 THEN 4 ELSE 10 END WHEN c_custkey % 20 = 17 THEN c_custkey - 10 ELSE c_custkey // 2 END AS t FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 20 IN (3, 7, 17)),
walk AS (SELECT DISTINCT o_custkey AS k, o_custkey AS place, [o_custkey] AS seen, false AS looped FROM orders
  UNION ALL SELECT k, t, seen || [t], list_contains(seen, t) FROM walk JOIN r ON r.s = walk.place WHERE NOT looped),
done AS (SELECT k, arg_max(place, len(seen)) AS place, bool_or(looped) AS looped FROM walk GROUP BY k)
SELECT o_orderkey, CASE WHEN looped THEN k ELSE place END AS target, CASE WHEN looped THEN 'loop' END AS reason FROM orders JOIN done ON k = o_custkey""")
def j25_redirects(spark, sf_dir):
    c = F.col("c_custkey")
    target = F.when(c % 20 == 3, c + 4).when(c % 20 == 7, c + 10).when(c % 20 == 17, c - 10).otherwise(F.expr("c_custkey div 2"))
    r = table(spark, sf_dir, "customer").where((c % 4 == 0) | (c % 20).isin(3, 7, 17)).select(c.alias("source"), target.alias("target"))
    return resolve.resolve_redirects(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), r, "o_custkey").select("o_orderkey", "target", "reason")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT max(event_type) FROM events))
SELECT e.user_id, CASE WHEN a.user_id IS NOT NULL AND b.user_id IS NOT NULL THEN 'both' WHEN a.user_id IS NOT NULL THEN 'first' WHEN b.user_id IS NOT NULL THEN 'second' ELSE 'none' END AS seen
FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN a ON e.user_id = a.user_id LEFT JOIN b ON e.user_id = b.user_id""")
def j23_two_systems(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    x = e.crossJoin(F.broadcast(ends))  # one row
    return resolve.two_system_classes(x.where("event_type = lo"), x.where("event_type = hi"), e, ["user_id"])


@query("SELECT c_custkey, coalesce(o.n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def j30_default_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0, ["n_orders"])


@query("""WITH m AS (SELECT user_id AS doc, event_id % 50 AS ent, event_id * 3 AS b, event_id * 3 + event_id % 3 AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT a.doc, a.ent AS ent_a, b.ent AS ent_b, CAST(a.i AS INTEGER) AS pos_a, CAST(b.i AS INTEGER) AS pos_b, b.b - a.e AS gap FROM m a JOIN m b ON a.doc = b.doc AND b.i > a.i AND b.i <= a.i + 9 WHERE b.b - a.e >= 0 AND b.b - a.e < 3000""")
def j20_mention_pairs(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc")).agg(F.sort_array(F.collect_list("event_id")).alias("x"))
    m = x.select("doc", F.transform("x", lambda y: F.struct((y % 50).alias("ent"), (y * 3).alias("begin"), (y * 3 + y % 3).alias("end"))).alias("mentions"))
    return mining.mention_pairs(m, "doc", "mentions", 9, 3000)


@query("""SELECT o_orderkey AS doc, o_custkey % 40 AS a, o_orderkey % 20 AS b, f.direction FROM orders
JOIN (SELECT s_suppkey AS s, s_suppkey // 2 AS o, 'forward' AS direction FROM supplier UNION ALL SELECT s_suppkey // 2, s_suppkey, 'backward' FROM supplier) f ON f.s = o_custkey % 40 AND f.o = o_orderkey % 20""")
def j21_either_direction(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 20).alias("b"))
    f = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.expr("s_suppkey div 2").alias("o"), F.lit("R").alias("relation"))
    return mining.either_direction(x, f, "a", "b", "s", "o", "relation").select("doc", "a", "b", "direction")


@query("""WITH p AS (SELECT l_orderkey, min(abs(a.l_quantity - b.l_quantity)) AS distance FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber % 2 = 1 AND b.l_linenumber % 2 = 0 GROUP BY 1) SELECT l_orderkey AS doc, CAST(distance AS INTEGER) AS distance FROM p WHERE distance <= 5""")
def j22_nearest(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, q)).alias("a"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, q)).alias("b"))
    return mining.nearest(x, "doc", "a", "b", 5)


@query("""SELECT user_id, event_id, CAST(sum(CASE WHEN event_id % 5 IN (3, 4) THEN 1 ELSE 0 END) OVER w AS BIGINT) AS sentence, CAST(sum(CASE WHEN event_id % 5 = 4 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS paragraph
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def w15_segments(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 5).alias("brk"))
    return mining.segments(x, "user_id", "event_id", "brk").drop("brk")


@query("""WITH x AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM x GROUP BY user_id, event_type, g""")
def w17_islands(spark, sf_dir):
    return mining.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, CAST(b AS INTEGER) AS block, array_to_string(w[b * 64 + 1 : b * 64 + 64], ' ') AS words FROM t, range(0, 1000000) r(b) WHERE b < len(w) // 64""")
def s36_token_blocks(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return mining.token_blocks(x, "doc_id", "w", 64).select("doc_id", "block", F.array_join("tokens", " ").alias("words"))


@query("""SELECT o_custkey AS a, o_orderkey AS b, l_suppkey AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def j12_two_hop(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("s"), F.lit("ordered").alias("r"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("o"))
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("s"), F.lit("from").alias("r"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("o"))
    p = mining.two_hop(o.unionByName(li), "s", "r", "o")
    num = lambda c: F.substring(F.col(c), 2, 20).cast("long").alias(c)
    return p.select(num("a"), num("b"), num("c"))


@query("""WITH p AS (SELECT o_custkey, o_orderpriority AS form, count(*) AS n, min(o_orderkey) AS o FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n, arg_max(form, n * 100000000 - o) AS form FROM p GROUP BY o_custkey""")
def a36_top_surface_form(spark, sf_dir):
    return mining.top_surface_form(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query()
def w24_greedy_capped(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_shipmode" if "l_shipmode" in table(spark, sf_dir, "lineitem").columns else "l_returnflag").alias("path"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_orderkey").alias("c"), F.col("l_extendedprice").alias("score"))
    return mining.greedy_capped(x, "path", ["a", "b", "c"], "score", 20, 100)


@query("""WITH w AS (SELECT lang, unnest(list_distinct(string_split(text, ' '))) AS word FROM documents) SELECT lang, word, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 10""")
def a41_template_counts(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    return x.groupBy("lang", "word").agg(F.count("*").alias("n")).where("n >= 10")


@query("""SELECT doc_id, regexp_replace(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' +', ' ', 'g') AS clean FROM documents""")
def f5_collapse_punctuation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_punctuation(F.lower("text")).alias("clean"))


@query("""SELECT page_id, list_extract(string_split(url, '/'), -1) AS tail FROM pages""")
def f1_uri_tail(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.uri_tail("url").alias("tail"))


@query("""SELECT n_nationkey, replace(replace('[X] lies in [Y] .', '[X]', n_name), '[Y]', r_name) AS sentence FROM nation JOIN region ON n_regionkey = r_regionkey""")
def f10_template_fill(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", T.fill(F.lit("[X] lies in [Y] ."), F.col("n_name"), F.col("r_name")).alias("sentence"))


@query("""SELECT o_orderkey, 'a ' || array_to_string(list_transform(range(0, 1 + o_orderkey % 4), lambda i: '[MASK]'), ' ') || ' b' AS prompt FROM orders""")
def f8_mask_run(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.set_masks(F.lit("a [MASK] [MASK] b"), (1 + F.col("o_orderkey") % 4).cast("int")).alias("prompt"))


_ANSWERS = """x AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name || ' of ' || n_name WHEN 1 THEN '##' || lower(n_name) WHEN 2 THEN '- ' || (c_custkey % 10) || ' .' WHEN 3 THEN substr(n_name, 1, 3) WHEN 4 THEN c_mktsegment ELSE '' END AS greedy,
  CASE WHEN c_custkey % 5 = 0 THEN '  ' || upper(n_name) || '!' ELSE c_mktsegment END AS ranked, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE n_name END AS subject FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_COMPARABLE = "trim(regexp_replace(replace(lower({0}), '##', ''), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {_ANSWERS}, y AS (SELECT c_custkey, {_COMPARABLE.format("greedy")} AS g, {_COMPARABLE.format("ranked")} AS r, {_COMPARABLE.format("subject")} AS s FROM x)
SELECT c_custkey, CASE WHEN length(replace(g, ' ', '')) <= 1 THEN 'non_informative' WHEN s <> '' AND (strpos(s, g) > 0 OR strpos(g, s) > 0 OR r = s) THEN 'subject_repetition' ELSE '' END AS label FROM y""")
def f35_error_label(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("n_name")
    greedy = F.when(k % 6 == 0, F.concat("c_name", F.lit(" of "), n)).when(k % 6 == 1, F.concat(F.lit("##"), F.lower(n))).when(k % 6 == 2, F.concat(F.lit("- "), (k % 10).cast("string"), F.lit(" .")))
    greedy = greedy.when(k % 6 == 3, F.substr(n, F.lit(1), F.lit(3))).when(k % 6 == 4, F.col("c_mktsegment")).otherwise("")
    ranked = F.when(k % 5 == 0, F.concat(F.lit("  "), F.upper(n), F.lit("!"))).otherwise(F.col("c_mktsegment"))
    x = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = x.select(k, T.comparable(greedy).alias("g"), T.comparable(ranked).alias("r"), T.comparable(F.when(k % 11 != 0, n)).alias("s"))
    return x.select("c_custkey", T.error_label(F.col("g"), F.col("r"), F.col("s")).alias("label"))


@query("""WITH x AS (SELECT p_partkey, p_name AS label, CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 'en' WHEN 2 THEN p_name || 'abcde' WHEN 3 THEN substr(p_name, 1, length(p_name) - 2) || 'xyz' WHEN 4 THEN p_name || ' x' WHEN 5 THEN 'é' || substr(p_name, 2) ELSE substr(p_name, 1, 1) || substr(p_name, 6) END AS form FROM part),
w AS (SELECT *, string_split(strip_accents(lower(label)), ' ') AS a, string_split(strip_accents(lower(form)), ' ') AS b FROM x),
z AS (SELECT *, list_transform(list_zip(a, b), lambda p: len(list_filter(range(1, length(p[1]) + 1), lambda i: length(p[2]) >= i AND substr(p[1], 1, i) = substr(p[2], 1, i)))) AS same FROM w)
SELECT p_partkey, form, a <> b AND (len(a) <> len(b) OR len(list_filter(range(1, len(a) + 1), lambda i: same[i] < greatest(1, length(a[i]) - 3) OR length(b[i]) - same[i] > 4)) > 0) AS malformed FROM z""")
def p19_malformed_inflection(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    form = F.when(k % 7 == 0, F.upper(n)).when(k % 7 == 1, F.concat(n, F.lit("en"))).when(k % 7 == 2, F.concat(n, F.lit("abcde"))).when(k % 7 == 3, F.concat(F.substr(n, F.lit(1), F.char_length(n) - 2), F.lit("xyz")))
    form = form.when(k % 7 == 4, F.concat(n, F.lit(" x"))).when(k % 7 == 5, F.concat(F.lit("é"), F.substr(n, F.lit(2)))).otherwise(F.concat(F.substr(n, F.lit(1), F.lit(1)), F.substr(n, F.lit(6))))
    x = table(spark, sf_dir, "part").select("p_partkey", n, form.alias("form"))
    return x.select("p_partkey", "form", T.malformed_inflection("p_name", "form").alias("malformed"))


@query("""SELECT doc_id, len(list_filter(string_split(translate(strip_accents(lower(coalesce(text, ''))), 'ßæœøđłªº', 'szzzzz'), ''), lambda c: c BETWEEN 'a' AND 'z')) > 0 AS latin FROM documents""")
def f14_is_latin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_latin(F.coalesce("text", F.lit(""))).alias("latin"))


@query("""WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '[Y].' WHEN 1 THEN '[' || c_name || ';Y;' || c_mktsegment || '] .' WHEN 2 THEN '[X] is [Y].' WHEN 3 THEN 'in [Y].' ELSE '[Y]' END AS prompt FROM customer)
SELECT c_custkey, prompt, right(prompt, 1) = '.' AND regexp_matches(rtrim(left(prompt, length(prompt) - 1)), '^\\[.*Y.*\\]$') AS at_end FROM x""")
def f12_ends_in_object(spark, sf_dir):
    k = F.col("c_custkey")
    prompt = F.when(k % 5 == 0, "[Y].").when(k % 5 == 1, F.concat(F.lit("["), "c_name", F.lit(";Y;"), "c_mktsegment", F.lit("] ."))).when(k % 5 == 2, "[X] is [Y].").when(k % 5 == 3, "in [Y].").otherwise("[Y]")
    return table(spark, sf_dir, "customer").select(k, prompt.alias("prompt")).select("c_custkey", "prompt", T.ends_in_object("prompt").alias("at_end"))


@query("""SELECT l_orderkey, l_linenumber, round(-l_extendedprice / pow(CAST(l_linenumber AS DOUBLE), 0.6), 6) AS score FROM lineitem""")
def f37_length_normalised(spark, sf_dir):
    from ..operators.ranking import length_normalised

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(length_normalised(-F.col("l_extendedprice"), F.col("l_linenumber"), 0.6)).alias("score"))
