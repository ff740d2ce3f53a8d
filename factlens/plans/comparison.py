"""Membership, run-against-run and selection queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare, membership, mining, ranking, splits
from .base import LANGS_SQL, PRED_SQL, language_facts, predictions, query, r6, table

#: A manifest in three parts, which overlap as listed: orders by status, price and priority.
_MANIFEST = """m AS (SELECT o_orderkey, 'train' AS part FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'val' FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'test' FROM orders WHERE o_orderpriority LIKE '1%')"""


def _manifest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = lambda p, w: o.where(w).select("o_orderkey", F.lit(p).alias("part"))
    return part("train", "o_orderstatus = 'O'").unionByName(part("val", "o_totalprice > 200000")).unionByName(part("test", "o_orderpriority LIKE '1%'"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount", "l_quantity")


def rounded(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query(f"WITH {_MANIFEST} SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM m WHERE part = 'val')")
def j6_listed(spark, sf_dir):
    m = _manifest(spark, sf_dir).where("part = 'val'").withColumnRenamed("o_orderkey", "l_orderkey")
    return membership.listed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], m)


@query(f"WITH {_MANIFEST} SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS r FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM m WHERE part = 'val')) WHERE r = 1")
def j6_first_listed(spark, sf_dir):
    m = _manifest(spark, sf_dir).where("part = 'val'").withColumnRenamed("o_orderkey", "l_orderkey")
    return membership.first_listed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), ["l_orderkey"], m, "l_linenumber")


@query(f"WITH {_MANIFEST} SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM m WHERE part = 'train') THEN 'train' WHEN o_orderkey IN (SELECT o_orderkey FROM m WHERE part = 'val') THEN 'val' WHEN o_orderkey IN (SELECT o_orderkey FROM m WHERE part = 'test') THEN 'test' END AS part FROM orders")
def j7_part_of(spark, sf_dir):
    return membership.with_part(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], _manifest(spark, sf_dir), ["train", "val", "test"])


@query(f"WITH {_MANIFEST} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN m USING (o_orderkey) WHERE m.part = 'val' AND o_totalprice > 400000)")
def j8_missing(spark, sf_dir):
    found = table(spark, sf_dir, "orders").where("o_totalprice > 400000").join(_manifest(spark, sf_dir).where("part = 'val'"), "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return membership.unlisted(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], found)


@query(f"WITH {_MANIFEST} SELECT o_orderkey, part FROM m WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
def j9_without_flagged(spark, sf_dir):
    flagged = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return membership.unlisted(_manifest(spark, sf_dir), ["o_orderkey"], flagged)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0) AND l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0)")
def j24_known_endpoints(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0")
    return membership.known_endpoints(_items(spark, sf_dir), "l_suppkey", "l_partkey", known, "s_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT c.o_custkey, p.o_orderpriority FROM (SELECT DISTINCT o_custkey FROM orders) c, (SELECT DISTINCT o_orderpriority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c.o_custkey AND x.o_orderpriority = p.o_orderpriority)")
def j29_missing_combinations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    return membership.missing_combinations(o, "o_custkey", "o_orderpriority", o)


@query(f"WITH {_MANIFEST} SELECT DISTINCT o_orderkey FROM m")
def u2_union_of_parts(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    return membership.union_distinct([m.where(F.col("part") == p).select("o_orderkey") for p in ("train", "val", "test")])


@query(f"""WITH {_MANIFEST}, c AS (SELECT o_orderkey, count(DISTINCT part) AS p FROM m GROUP BY 1), e AS (SELECT o.o_orderkey AS w, c.o_orderkey AS k, p FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) o FULL JOIN c ON o.o_orderkey = c.o_orderkey)
SELECT count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (w IS NULL) AS extra, count(*) FILTER (p > 1) AS shared FROM e""")
def u5_partition_check(spark, sf_dir):
    m, o = _manifest(spark, sf_dir), table(spark, sf_dir, "orders")
    return membership.partition_check(o.where("o_totalprice > 100000"), {p: m.where(F.col("part") == p) for p in ("train", "val", "test")}, ["o_orderkey"])


@query(f"WITH {LANGS_SQL} SELECT DISTINCT fact, relation FROM facts WHERE correct = 1")
def u6_facts_right_anywhere(spark, sf_dir):
    return membership.union_distinct([language_facts(spark, sf_dir).where("correct = 1").select("fact", "relation")])


@query("SELECT n_nationkey AS key, n_name AS name, NULL::BIGINT AS supplier FROM nation UNION ALL SELECT NULL, s_name, s_suppkey FROM supplier")
def u7_concat(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return membership.concat([n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("supplier"))])


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.09 OR l_tax > 0.07")
def u8_flagged_in_any(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return membership.union_distinct([x.where(w).select("l_orderkey") for w in ("l_discount > 0.09", "l_tax > 0.07")])


@query("SELECT DISTINCT e AS entity FROM (SELECT unnest([l_suppkey, l_partkey]) AS e FROM lineitem)")
def a45_entities(spark, sf_dir):
    return membership.entities_of(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"])


@query("SELECT c_nationkey AS nation, count(*) FILTER (c_acctbal > 9000) AS n FROM customer GROUP BY 1")
def a47_counts_with_zero(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    return membership.counts_of(c, "nation", c.where("c_acctbal > 9000"))


@query("SELECT lang, source AS relation, count(*) AS n FROM documents GROUP BY ALL")
def a49_language_relation_counts(spark, sf_dir):
    return membership.frequent(table(spark, sf_dir, "documents").select("lang", F.col("source").alias("relation")), ["lang", "relation"], 1)


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 10")
def a37_frequent(spark, sf_dir):
    return membership.frequent(table(spark, sf_dir, "lineitem"), ["l_partkey"], 10)


@query("SELECT l_returnflag AS first, l_linestatus AS second, count(*) AS n FROM lineitem GROUP BY ALL")
def a39_path_types(spark, sf_dir):
    return membership.frequent(_items(spark, sf_dir).select(F.col("l_returnflag").alias("first"), F.col("l_linestatus").alias("second")), ["first", "second"], 1)


@query("SELECT coalesce(event_type, 'all') AS context, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, user_id), (user_id))")
def a59_counts_with_total(spark, sf_dir):
    return membership.counts_with_total(table(spark, sf_dir, "events").select(F.col("event_type").alias("context"), "user_id"), "context", "user_id")


@query("""WITH f AS (SELECT o_custkey AS sub, o_orderstatus AS relation, o_orderkey % 10 AS obj FROM orders WHERE o_totalprice > 250000), x AS (SELECT o_custkey AS sub, o_orderstatus AS relation, o_orderkey % 7 AS obj FROM orders),
u AS (SELECT * FROM f UNION SELECT * FROM x WHERE (sub, relation) IN (SELECT (sub, relation) FROM f)) SELECT sub, relation, array_to_string(list_sort(list(obj)), ' ') AS objects FROM u GROUP BY ALL""")
def a44_objects(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sub"), F.col("o_orderstatus").alias("relation"), "o_orderkey", "o_totalprice")
    f, x = o.where("o_totalprice > 250000").withColumn("obj", F.col("o_orderkey") % 10), o.withColumn("obj", F.col("o_orderkey") % 7)
    got = membership.objects_of(f, x, "sub", "relation", "obj")
    return got.select("sub", "relation", F.array_join(F.transform("objects", lambda v: v.cast("string")), " ").alias("objects"))


@query("""WITH p AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rank FROM p) SELECT o_custkey, o_orderpriority, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def a38_top_names(spark, sf_dir):
    return compare.top_by_count(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", 3)


@query("SELECT o_orderpriority, CAST(CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS INTEGER) AS place FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def o4_preferred_order(spark, sf_dir):
    keys = membership.preferred("o_orderpriority", ["3-MEDIUM", "1-URGENT"])
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct().orderBy(*keys).select("o_orderpriority", keys[0].alias("place"))


_AVG = f"{LANGS_SQL}, s AS (SELECT relation, fact, lang, avg(correct) AS c FROM facts GROUP BY ALL)"


@query(f"WITH {_AVG} SELECT a.relation, a.fact, a.lang AS run_a, b.lang AS run_b, a.c AS value_a, b.c AS value_b FROM s a JOIN s b ON a.relation = b.relation AND a.fact = b.fact AND a.lang < b.lang")
def j13_run_pairs(spark, sf_dir):
    x = language_facts(spark, sf_dir).groupBy("relation", "fact", "lang").agg(F.avg("correct").alias("c"))
    return compare.run_pairs(x, ["relation", "fact"], "lang", "c")


@query(f"""WITH {_AVG}, p AS (SELECT a.lang AS run_a, b.lang AS run_b, a.relation, avg(a.c) AS a, avg(b.c) AS b, count(*) AS n FROM s a JOIN s b ON a.relation = b.relation AND a.fact = b.fact AND a.lang < b.lang GROUP BY ALL)
SELECT run_a, run_b, round(avg(a), 6) AS macro_a, round(avg(b), 6) AS macro_b, round(avg(b - a), 6) AS difference, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL""")
def a22_paired_comparison(spark, sf_dir):
    return rounded(compare.paired_comparison(language_facts(spark, sf_dir), "lang", "relation", "fact"), "macro_a", "macro_b", "difference")


@query(f"WITH {PRED_SQL} SELECT relation, round(avg(correct), 6) AS correct, round(avg(nullif(gold_len, 1)), 6) AS gold_len, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(DISTINCT seed) AS n_runs FROM pred GROUP BY relation")
def a25_ablation_means(spark, sf_dir):
    x = predictions(spark, sf_dir).withColumn("gold_len", F.when(F.col("gold_len") != 1, F.col("gold_len")))
    return rounded(compare.ablation_means(x, ["relation"], ["correct", "gold_len"], "lang", "seed"), "correct", "gold_len")


@query(f"WITH {PRED_SQL} SELECT lang, relation, round(avg(gold_len), 6) AS mean, round(stddev_samp(gold_len), 6) AS std, count(DISTINCT seed) AS n_seeds FROM pred GROUP BY ALL")
def a50_value_stats(spark, sf_dir):
    return rounded(compare.value_stats(predictions(spark, sf_dir), ["lang", "relation"], "gold_len", "seed"), "mean", "std")


@query(f"""WITH {LANGS_SQL}, s AS (SELECT relation, seed, avg(correct) AS m, max(CASE WHEN lang = 'RF' THEN 1 ELSE 0 END) AS has_rf, max(CASE WHEN correct = 0 THEN 1 ELSE 0 END) AS has_wrong FROM facts GROUP BY ALL)
SELECT relation, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, CAST(sum(has_rf) AS BIGINT) AS has_rf, CAST(sum(has_wrong) AS BIGINT) AS has_wrong FROM s GROUP BY relation""")
def a51_sweep(spark, sf_dir):
    flags = {"has_rf": F.col("lang") == "RF", "has_wrong": F.col("correct") == 0}
    return rounded(compare.sweep(language_facts(spark, sf_dir), ["relation"], "seed", "correct", flags), "mean", "std")


@query("SELECT l_linenumber AS epoch, l_returnflag AS lang, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL")
def a53_epoch_curve(spark, sf_dir):
    x = _items(spark, sf_dir).select(F.col("l_linenumber").alias("epoch"), F.col("l_returnflag").alias("lang"), "l_extendedprice")
    return compare.means(x, ["epoch", "lang"], "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("""WITH p AS (SELECT l_linestatus AS run, l_returnflag AS lang, sum(l_discount) AS l, sum(l_quantity) AS t FROM lineitem GROUP BY ALL)
SELECT run, round(avg(l / t), 6) AS language_mean, round(sum(l) / sum(t), 6) AS token_mean, round(exp(avg(l / t)), 6) AS perplexity FROM p GROUP BY run""")
def a55_language_loss(spark, sf_dir):
    x = _items(spark, sf_dir).select(F.col("l_linestatus").alias("run"), F.col("l_returnflag").alias("lang"), "l_discount", "l_quantity")
    return rounded(compare.language_loss(x, ["run"], "lang", "l_discount", "l_quantity"), "language_mean", "token_mean", "perplexity")


@query("""WITH e AS (SELECT l_suppkey, l_linenumber AS epoch, avg(l_extendedprice) AS l FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l, epoch) AS r, max(epoch) OVER (PARTITION BY l_suppkey) AS last_epoch, min(epoch) OVER (PARTITION BY l_suppkey) AS f FROM e)
SELECT l_suppkey, epoch AS best_epoch, round(l, 2) AS best_loss, last_epoch, epoch <= f + 1 AS early_best, epoch = last_epoch AS last_best FROM r WHERE r = 1""")
def a57_best_epoch(spark, sf_dir):
    return compare.best_epoch(_items(spark, sf_dir), ["l_suppkey"], "l_linenumber", "l_extendedprice").withColumn("best_loss", F.round("best_loss", 2))


@query("""WITH e AS (SELECT l_suppkey, l_linenumber AS epoch, avg(l_extendedprice) AS l FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l, epoch) AS r, max(epoch) OVER (PARTITION BY l_suppkey) AS last_epoch, min(epoch) OVER (PARTITION BY l_suppkey) AS f FROM e)
SELECT count(*) AS n_runs, count(*) FILTER (epoch <= f + 1) AS early, count(*) FILTER (epoch = last_epoch) AS last FROM r WHERE r = 1""")
def a62_early_and_last_best(spark, sf_dir):
    x = compare.best_epoch(_items(spark, sf_dir), ["l_suppkey"], "l_linenumber", "l_extendedprice")
    return x.agg(F.count("*").alias("n_runs"), F.count_if("early_best").alias("early"), F.count_if("last_best").alias("last"))


@query("""WITH p AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'N') AS kept, avg(l_quantity) FILTER (l_returnflag = 'R') AS dropped FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(kept, 6) AS kept, round(dropped, 6) AS dropped, round(kept - dropped, 6) AS difference FROM p WHERE kept IS NOT NULL AND dropped IS NOT NULL""")
def a60_variant_difference(spark, sf_dir):
    return rounded(compare.variant_difference(_items(spark, sf_dir), ["l_suppkey"], "l_returnflag", "l_quantity", "N", "R"), "kept", "dropped", "difference")


@query("WITH p AS (SELECT lang, avg(n_chars) AS mean FROM documents GROUP BY 1) SELECT lang, round(mean, 4) AS mean, round((SELECT mean FROM p WHERE lang = (SELECT min(lang) FROM documents WHERE lang = 'en')) - mean, 4) AS drop FROM p WHERE EXISTS (SELECT 1 FROM p WHERE lang = 'en')")
def a61_baseline_drop(spark, sf_dir):
    x = compare.baseline_drop(table(spark, sf_dir, "documents"), "lang", "n_chars", "en")
    return x.select("lang", F.round("mean", 4).alias("mean"), F.round("drop", 4).alias("drop"))


@query(f"""WITH {LANGS_SQL}, p AS (SELECT relation, fact, max(CASE WHEN lang = 'NO' THEN correct END) AS a, max(CASE WHEN lang = 'RF' THEN correct END) AS b FROM facts GROUP BY ALL)
SELECT relation, round(sum(a * b) / greatest(sum(greatest(a, b)), 1), 6) AS overlap, count(*) AS n_common FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY relation""")
def a19_overlap_restricted(spark, sf_dir):
    return rounded(compare.overlap_restricted(language_facts(spark, sf_dir), ["relation"], "fact", "lang", "NO", "RF"), "overlap")


@query("WITH f AS (SELECT l_suppkey, avg(CASE WHEN l_discount >= l_tax THEN 1 ELSE 0 END) AS m FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL GROUP BY 1) SELECT round(avg(m), 6) AS share, count(*) AS n_files FROM f")
def a29_share_at_least(spark, sf_dir):
    return rounded(compare.share_at_least(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount", "l_tax"), "share")


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_quantity AS l_quantity_a, b.l_quantity AS l_quantity_b FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber WHERE a.l_returnflag = 'N' AND b.l_discount > 0.03")
def j10_positional(spark, sf_dir):
    x = _items(spark, sf_dir)
    return compare.positional(x.where("l_returnflag = 'N'"), x.where("l_discount > 0.03"), ["l_orderkey"], "l_linenumber", ["l_quantity"])


@query("SELECT user_id, event_id, value AS value_a, value AS value_b FROM events")
def j11_positional_strict(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return compare.positional(x, x, ["user_id"], "event_id", ["value"], strict=True)


@query("""WITH x AS (SELECT user_id AS item, 'u' || (event_id % 5) AS who, min(event_type) AS label FROM events GROUP BY 1, 2), p AS (SELECT a.who AS run_a, b.who AS run_b, a.label AS a, b.label AS b FROM x a JOIN x b ON a.item = b.item AND a.who < b.who),
t AS (SELECT run_a, run_b, count(*) AS n, count(*) FILTER (a = b) / count(*) AS po FROM p GROUP BY 1, 2), l AS (SELECT DISTINCT label FROM x),
e AS (SELECT t.run_a, t.run_b, sum((SELECT count(*) FROM p WHERE p.run_a = t.run_a AND p.run_b = t.run_b AND p.a = l.label) * (SELECT count(*) FROM p WHERE p.run_a = t.run_a AND p.run_b = t.run_b AND p.b = l.label)) / (any_value(n) * any_value(n)) AS pe FROM t, l GROUP BY 1, 2)
SELECT t.run_a, t.run_b, n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM t JOIN e USING (run_a, run_b) WHERE n >= 10""")
def a35_annotator_kappas(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.concat(F.lit("u"), (F.col("event_id") % 5).cast("string")).alias("who"), "event_type")
    x = e.groupBy("item", "who").agg(F.min("event_type").alias("label"))
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]  # the label set
    return rounded(compare.annotator_kappas(x, "item", "who", "label", kinds), "agreement", "kappa")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem) SELECT l_suppkey, l_extendedprice, l_partkey FROM r WHERE r = 1""")
def w23_extreme_row(spark, sf_dir):
    x = _items(spark, sf_dir).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return compare.extreme_row(x, ["l_suppkey"], "l_extendedprice", "o", ["l_partkey"])


@query("""WITH r AS (SELECT o_orderstatus AS relation, o_orderkey, o_totalprice <= 150000 AS single, count(*) FILTER (o_totalprice <= 150000) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS k FROM orders)
SELECT relation, o_orderkey, CAST(k AS INTEGER) AS nth, (SELECT count(*) FROM r s WHERE s.relation = r.relation AND NOT s.single AND s.o_orderkey < r.o_orderkey) AS skipped FROM r WHERE single AND k <= 10""")
def w10_first_examples(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("relation"), "o_orderkey", "o_totalprice")
    return splits.first_examples(x, ["relation"], "o_orderkey", F.col("o_totalprice") <= 150000, 10).select("relation", "o_orderkey", "nth", "skipped")


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 300 AS batch FROM customer")
def w28_batches(spark, sf_dir):
    return splits.every_n(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 300)


@query("WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem WHERE l_discount > 0.02), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM c) SELECT l_orderkey, l_suppkey FROM r WHERE r = 1")
def w12_masked_argmax(spark, sf_dir):
    return ranking.argmax_first(_items(spark, sf_dir).where("l_discount > 0.02"), ["l_orderkey"], "l_extendedprice", "l_linenumber", ["l_suppkey"])


@query("WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice > 200000 AS positive, count(*) FILTER (o_totalprice > 200000) OVER (PARTITION BY o_custkey) AS n_pos, row_number() OVER (PARTITION BY o_custkey, o_totalprice > 200000 ORDER BY o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey, positive FROM r WHERE positive OR r <= n_pos")
def w26_negatives(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 200000).alias("positive"))
    return splits.balanced_negatives(x, ["o_custkey"], "positive", "o_orderkey")


@query("SELECT n_nationkey, lower(n_name) AS low, upper(n_name[1]) || lower(n_name[2:]) AS title FROM nation")
def f15_capitalised(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("low"), T.like_case(F.lower("n_name"), F.lit("Xx")).alias("title"))


@query("""SELECT doc_id, list_extract(w, 1) IS NOT NULL AND list_extract(w, 1) <> '' AND NOT regexp_matches(w[1], '^[^\\p{L}\\p{N}]') AND len(w) <= 10 AND len(list_filter(w, lambda x: NOT list_contains(['the', 'of'], lower(x)))) > 0 AS valid
FROM (SELECT doc_id, list_filter(string_split(regexp_replace(left(text, 60), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)""")
def p16_valid_template(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.valid_template(F.regexp_replace(F.left("text", F.lit(60)), r"\s+", " "), ["the", "of"], 10).alias("valid"))


@query("SELECT doc_id, lower(trim(coalesce(source, ''))) AS label, lower(trim(coalesce(source, ''))) IN ('web', 'news', '') AS allowed FROM documents")
def p18_labels(spark, sf_dir):
    label, allowed = T.annotation_label("source", ["web", "news", ""])
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), allowed.alias("allowed"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount IS NULL THEN '' ELSE printf('%.4f', l_discount) END AS cell FROM lineitem")
def f41_rounded_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.number_text("l_discount", 4).alias("cell"))


@query("SELECT doc_id, w[1] || ' [E1] ' || w[2] || ' [/E1] ' || array_to_string(w[3:], ' ') AS marked FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE len(w) >= 3")
def f34_insert_brackets(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w")).where(F.size("w") >= 3)
    return x.select("doc_id", F.array_join(T.insert_brackets("w", [(1, 2, "E1")]), " ").alias("marked"))


@query("SELECT user_id, count(*) AS n_mentions FROM (SELECT user_id, event_id FROM events) GROUP BY 1")
def w16_w18_offsets(spark, sf_dir):
    """Mentions of one letter, two apart: none overlaps another, so all are claimed, and each starts where its offset says."""
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    tokens = F.array_repeat(F.lit("a"), F.col("n").cast("int"))
    m = F.transform(mining.char_offsets(tokens), lambda o: F.struct(F.lit("e").alias("ent"), o.cast("long").alias("begin"), (o + 1).cast("long").alias("end")))
    return x.withColumn("__m", m).select("user_id", F.size(mining.claim_positions("__m")).cast("long").alias("n_mentions"))
