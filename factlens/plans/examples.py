"""Example building, document supervision, orders and the text rules around them, on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import examples, membership, splits
from .base import query, r6, table


@query("""WITH f AS (SELECT DISTINCT l_suppkey % 3 AS r, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey % 3 < 2),
x AS (SELECT 'R' || r AS relation, 'p' || l_partkey AS sub, 's' || l_suppkey AS obj, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS a,
  CASE s_suppkey % 4 WHEN 0 THEN s_name || ' and sons ltd' WHEN 1 THEN '[UNK] ' || s_name WHEN 2 THEN ' ' ELSE s_name END AS b, s_nationkey, r FROM f JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
y AS (SELECT *, CASE WHEN a IS NULL THEN 'no_subject' WHEN trim(b) = '' THEN 'empty' WHEN b LIKE '[UNK]%' THEN 'unknown' END AS reason, len(list_filter(string_split(b, ' '), lambda w: w <> '')) AS n FROM x)
SELECT relation, sub, obj, CASE WHEN reason IS NULL THEN a || CASE r WHEN 0 THEN ' ב' ELSE ' in ' END || CASE WHEN n = 1 THEN '[MASK]' ELSE '[MASK] [MASK]' END || ' .' END AS prompt,
  CASE WHEN reason IS NULL THEN b END AS answer, CASE WHEN reason IS NULL THEN CAST(least(n, 2) AS INTEGER) END AS n_masks, reason FROM y""")
def m3_examples(spark, sf_dir):
    """Joins of templates (inner), labels, sexes and kinds (left, with defaults), both roles filled, masks counted, reasons given."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    facts = li.select(F.concat(F.lit("R"), F.col("l_suppkey") % 3).alias("relation"), F.concat(F.lit("p"), "l_partkey").alias("sub"), F.concat(F.lit("s"), "l_suppkey").alias("obj"))
    templates = spark.createDataFrame([("R0", "[X] ב[Y] ."), ("R1", "[X] in [Y] .")], "relation string, template string")
    of_p = p.where("p_partkey % 5 > 0").select(F.concat(F.lit("p"), "p_partkey").alias("uri"), F.col("p_name").alias("label"))
    key = F.col("s_suppkey") % 4
    name = F.when(key == 0, F.concat("s_name", F.lit(" and sons ltd"))).when(key == 1, F.concat(F.lit("[UNK] "), "s_name")).when(key == 2, " ").otherwise(F.col("s_name"))
    of_s = s.select(F.concat(F.lit("s"), "s_suppkey").alias("uri"), name.alias("label"))
    sexes = of_p.where("uri LIKE '%1'").select("uri", F.lit("female").alias("sex"))
    kinds = of_p.where("uri LIKE '%2'").select("uri", F.lit("human").alias("kind"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return examples.build_examples(facts, templates, of_p.unionByName(of_s), sexes, kinds, "he", 2, words)


@query("""SELECT l_returnflag, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n > 1) AS n_multi, count(*) FILTER (n < 1) AS n_none, round(avg(n), 6) AS mean_length, max(n) AS max_length, count(*) FILTER (n < 1) = 0 AS complete
FROM (SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN l_linenumber % 3 ELSE l_linenumber END AS n FROM lineitem) GROUP BY 1""")
def a4_length_partition(spark, sf_dir):
    n = F.when(F.col("l_returnflag") == "A", F.col("l_linenumber") % 3).otherwise(F.col("l_linenumber"))
    x = examples.length_partition(table(spark, sf_dir, "lineitem").select("l_returnflag", n.alias("n")), "l_returnflag", "n")
    return x.withColumn("mean_length", r6(F.col("mean_length")))


@query("""WITH m AS (SELECT l_orderkey AS doc, l_linenumber AS sentence, l_linenumber // 3 AS paragraph, l_suppkey % 10 AS entity FROM lineitem), s AS (SELECT doc, min(entity) AS sub FROM m GROUP BY doc),
f AS (SELECT DISTINCT l_suppkey % 10 AS sub, 'P' || (l_partkey % 5) AS property, l_partkey * 7 % 10 AS tail FROM lineitem),
h AS (SELECT m.doc, property, tail, m.sentence, CASE WHEN EXISTS (FROM m o WHERE o.doc = m.doc AND o.entity = s.sub AND o.sentence = m.sentence) THEN 1 WHEN EXISTS (FROM m o WHERE o.doc = m.doc AND o.entity = s.sub AND o.paragraph = m.paragraph) THEN 2 END AS grain
  FROM m JOIN s ON m.doc = s.doc JOIN f ON f.sub = s.sub AND f.tail = m.entity)
SELECT doc, property, tail, grain, sentence FROM h WHERE grain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, property ORDER BY grain, sentence, tail) = 1""")
def j28_document_hits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("sentence"), F.floor(F.col("l_linenumber") / 3).alias("paragraph"), (F.col("l_suppkey") % 10).alias("entity"))
    s = m.groupBy("doc").agg(F.min("entity").alias("sub"))
    f = li.select((F.col("l_suppkey") % 10).alias("sub"), F.concat(F.lit("P"), F.col("l_partkey") % 5).alias("property"), (F.col("l_partkey") * 7 % 10).alias("tail")).distinct()
    return examples.document_hits(m, s, f)


@query("""SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('1|' || o_orderkey), o_orderkey) <= 3""")
def w8_exact_sample(spark, sf_dir):
    return examples.exact_sample(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 3, 1)


@query("""SELECT user_id, 'checkpoint-' || event_id AS name, event_id AS step FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2""")
def o11_newest(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("checkpoint-"), "event_id").alias("name"))
    return examples.newest(x, "user_id", "name", 2)


@query("""SELECT l_orderkey, max(l_quantity) FILTER (l_returnflag = 'A') AS A, max(l_quantity) FILTER (l_returnflag = 'N') AS N, max(l_quantity) FILTER (l_returnflag = 'R') AS R,
max(l_quantity) FILTER (l_returnflag = 'A') - max(l_quantity) FILTER (l_returnflag = 'R') AS difference FROM lineitem GROUP BY 1""")
def j32_side_by_side(spark, sf_dir):
    return examples.side_by_side(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity", ["A", "N", "R"], ("A", "R"))


@query("""SELECT n_nationkey, n_name, c.n AS n, s.n AS n_suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON n_nationkey = c.k LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON n_nationkey = s.k""")
def j33_enriched(spark, sf_dir):
    of = lambda t, k: table(spark, sf_dir, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias("n"))
    return examples.enriched(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), [(of("customer", "c_nationkey"), "_customers"), (of("supplier", "s_nationkey"), "_suppliers")], ["n_nationkey"])


@query("""SELECT l_returnflag, round(avg(l_discount), 6) AS mean, round(avg(l_discount - l_tax), 6) AS gain, count(DISTINCT l_linestatus) AS n_langs FROM lineitem GROUP BY 1""")
def a64_averaged_gain(spark, sf_dir):
    x = examples.averaged_gain(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_discount", "l_tax")
    return x.select("l_returnflag", r6(F.col("mean")).alias("mean"), r6(F.col("gain")).alias("gain"), "n_langs")


_HEX = " + ".join(f"(instr('0123456789abcdef', substr(h, {i}, 1)) - 1) * {16 ** (4 - i)}" for i in (1, 2, 3, 4))


@query(f"""WITH d AS (SELECT lang, source, doc_id, md5('1|' || lang || '|' || doc_id) AS h, count(*) OVER (PARTITION BY lang) AS n, min(doc_id) OVER (PARTITION BY lang, source) AS f FROM documents)
SELECT lang, source, doc_id FROM d WHERE doc_id = f OR ({_HEX}) / 65536.0 < 20 / n""")
def w27_rebalanced(spark, sf_dir):
    return examples.rebalanced(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id", 20, 1).select("lang", "source", "doc_id")


@query("""SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN n_name END AS en, CASE n_nationkey % 2 WHEN 1 THEN n_name END AS fr FROM nation""")
def p12_labels_of_language(spark, sf_dir):
    v = F.concat(F.lit('"'), "n_name", F.when(F.col("n_nationkey") % 2 == 0, '"@en').otherwise('"@fr'))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.quoted_label(v, "en").alias("en"), T.quoted_label(v, "fr").alias("fr"))


@query("""SELECT o_orderkey, 'cafe "a" ' || lower(o_orderpriority) AS text FROM orders""")
def f40_tokenizer_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.tokenizer_text(F.concat(F.lit("  Café \t ``a''  "), "o_orderpriority"), lower=True).alias("text"))


@query("""SELECT o_orderkey, 'a ' || o_orderstatus || ' c ' || o_orderpriority || ' d' AS clean, '2' AS x, CASE WHEN contains(o_orderpriority, ' ') THEN '4-5' ELSE '4' END AS y FROM orders""")
def f33_bracket_spans(spark, sf_dir):
    clean, x, y = T.bracket_spans(F.concat(F.lit("a [[ "), "o_orderstatus", F.lit(" ]]_x c [[ "), "o_orderpriority", F.lit(" ]]_y d")))
    return table(spark, sf_dir, "orders").select("o_orderkey", clean.alias("clean"), x.alias("x"), y.alias("y"))


@query("""SELECT o_orderkey, 'in:' || year(o_orderdate) || ' [' || o_custkey || '] ' || o_orderstatus AS text FROM orders""")
def p17_dated_words(spark, sf_dir):
    words = F.array(F.lit("in"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"))
    dates = F.array(F.year("o_orderdate").cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.dated_words(words, dates), " ").alias("text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'P' || o_custkey END AS prop, CASE WHEN o_orderkey % 4 < 2 THEN CAST(year(o_orderdate) AS BIGINT) END AS year FROM orders""")
def f43_date_property(spark, sf_dir):
    k, year = F.col("o_orderkey") % 4, F.year("o_orderdate").cast("string")
    got = T.date_property(F.concat(F.lit("P"), "o_custkey"), F.when(k == 2, "/w/item").otherwise("/w/time"), F.when(k == 0, year).otherwise("Q5"), F.when(k == 1, year))
    return table(spark, sf_dir, "orders").select("o_orderkey", got.alias("g")).select("o_orderkey", "g.prop", "g.year")


@query("""SELECT n_name AS label, 'N;' || c || ';' || n AS tag FROM nation, (SELECT unnest(['NOM', 'GEN', 'ACC']) AS c), (SELECT unnest(['SG', 'PL']) AS n)""")
def f30_inflection_grid(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.explode(T.inflection_grid("n_name", ["NOM", "GEN", "ACC"], ["SG", "PL"])).alias("g")).select("g.label", "g.tag")


@query("""SELECT n_nationkey, n_name || ' in {region} ' || n_regionkey AS text FROM nation""")
def f32_fill_some(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", T.fill_some(F.lit("{name} in {region} {key}"), {"name": "n_name", "key": F.col("n_regionkey").cast("string")}).alias("text"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_custkey, o_orderkey) - 1 AS place FROM orders""")
def o2_fact_order(spark, sf_dir):
    return splits.numbered(table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", "o_orderkey"), ["o_orderpriority", "o_custkey", "o_orderkey"], "place").select("o_orderkey", "place")


@query("""WITH c AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1) SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS place FROM c""")
def o5_by_size(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).withColumn("less", -F.col("n"))
    return splits.numbered(x, ["less", "user_id"], "place").select("user_id", "n", "place")


@query("""SELECT o_orderkey FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 50""")
def o9_random_subset(spark, sf_dir):
    """A bounded sample is the feature."""
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy(splits.shuffled(7, "o_orderkey"), "o_orderkey").limit(50)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000)""")
def p8_listed_relations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").alias("l_suppkey"))
    return membership.listed(table(spark, sf_dir, "lineitem"), ["l_suppkey"], s).select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')""")
def p13_no_categories(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    return membership.unlisted(table(spark, sf_dir, "orders"), ["o_custkey"], c).select("o_orderkey")


def _draw_sql(seed: int, at: str, first: int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', conv_id, turn, {at})), {first}, 7) AS BIGINT)"


_HIT = f"{_draw_sql(5, 'i - 1', 1)} < CASE WHEN regexp_matches(w, '^[A-Z]') THEN {int(0.4 * 16**7)} ELSE {int(0.15 * 16**7)} END AND length(w) > 0"


@query(f"""WITH f AS (SELECT conv_id, turn, CASE WHEN {_draw_sql(4, "'form'", 1)} < {int(0.5 * 16**7)} THEN text ELSE role || ' ' || text END AS line FROM conversations),
x AS (SELECT conv_id, turn, string_split(line, ' ') AS words FROM f WHERE line IS NOT NULL)
SELECT conv_id, turn, array_to_string(list_transform(words, lambda w, i: CASE WHEN NOT ({_HIT}) THEN length(w)
    WHEN {_draw_sql(5, 'i - 1', 8)} < {int(0.8 * 16**7)} THEN 103 WHEN {_draw_sql(5, 'i - 1', 8)} < {int(0.9 * 16**7)} THEN {_draw_sql(5, 'i - 1', 15)} % 500 ELSE length(w) END), ' ') AS inputs,
  array_to_string(list_transform(words, lambda w, i: CASE WHEN {_HIT} THEN length(w) ELSE -100 END), ' ') AS labels FROM x""")
def m10_m11_masking(spark, sf_dir):
    """A form of each turn by a draw, then 80/10/10 masking with a rate of its own for capitalised words; a word's length stands for its id, 0 is never masked."""
    x = table(spark, sf_dir, "conversations").withColumn("switched", F.concat("role", F.lit(" "), "text"))
    x = examples.raw_or_switched(x, ["conv_id", "turn"], "text", "switched", 4, 0.5, "line").where("line IS NOT NULL")
    x = x.withColumn("words", F.split("line", " ", -1))
    x = x.withColumns({"ids": F.transform("words", F.char_length), "named": F.transform("words", lambda w: w.rlike("^[A-Z]"))})
    x = examples.masked_tokens(x, ["conv_id", "turn"], "ids", 5, 0.15, 103, 500, mentions="named", mention_rate=0.4, never=(0,))
    return x.select("conv_id", "turn", *[F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c) for c in ("inputs", "labels")])
