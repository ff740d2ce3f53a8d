"""Metric, statistic and ranking queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, ranking, splits, stats
from .base import LANGS_SQL, PRED_SQL, language_facts, n_words, predictions, query, r6, table

EDGES = ((100, "1-100"), (300, "101-300"), (1000, "301-1000"), (None, "1001+"))
BUCKET_SQL = "CASE WHEN gold_len <= 100 THEN '1-100' WHEN gold_len <= 300 THEN '101-300' WHEN gold_len <= 1000 THEN '301-1000' ELSE '1001+' END"


def rounded(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query(f"""WITH {PRED_SQL}, a AS (SELECT lang, {BUCKET_SQL} AS bucket, seed, avg(correct) AS m, count(*) AS n FROM pred GROUP BY ALL)
SELECT lang, bucket, round(avg(m), 6) AS em_mean, round(stddev_samp(m), 6) AS em_std, round(avg(n), 6) AS n FROM a GROUP BY ALL""")
def a14_em_by_length(spark, sf_dir):
    return rounded(metrics.em_by_length(predictions(spark, sf_dir), ["lang"], edges=EDGES), "em_mean", "em_std", "n")


@query(f"""WITH {PRED_SQL}, s AS (SELECT lang, relation, correct, unnest(['all', CASE WHEN gold_len <= 1 THEN 'single' ELSE 'multi' END]) AS subset FROM pred),
a AS (SELECT lang, subset, relation, sum(correct) AS k, count(*) AS n FROM s GROUP BY ALL)
SELECT lang, subset, round(avg(k / n), 6) AS macro, round(sum(k) / sum(n), 6) AS micro, CAST(sum(n) AS BIGINT) AS n, count(*) AS num_relations FROM a GROUP BY ALL""")
def a8_subset_metrics(spark, sf_dir):
    return rounded(metrics.subset_metrics(predictions(spark, sf_dir), ["lang"]), "macro", "micro")


_REL = """r AS (SELECT relation, sum(correct) / count(*) AS acc_all, coalesce(sum(correct) FILTER (gold_len <= 1), 0) / greatest(count(*) FILTER (gold_len <= 1), 1) AS acc_single,
  coalesce(sum(correct) FILTER (gold_len > 1), 0) / greatest(count(*) FILTER (gold_len > 1), 1) AS acc_multi FROM pred GROUP BY relation)"""


@query(f"WITH {PRED_SQL}, {_REL} SELECT relation, round(acc_all, 6) AS acc_all, round(acc_single, 6) AS acc_single, round(acc_multi, 6) AS acc_multi FROM r")
def a5_relation_accuracy(spark, sf_dir):
    return rounded(metrics.relation_accuracy(predictions(spark, sf_dir)), "acc_all", "acc_single", "acc_multi")


@query(f"WITH {PRED_SQL}, {_REL} SELECT round(avg(acc_all), 6) AS acc_all, round(avg(acc_single), 6) AS acc_single, round(avg(acc_multi), 6) AS acc_multi FROM r")
def a6_macro_with_zeros(spark, sf_dir):
    return rounded(metrics.macro_with_zeros(predictions(spark, sf_dir)), "acc_all", "acc_single", "acc_multi")


@query("""WITH r AS (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type) SELECT round(avg(1.0 / greatest(n, 1)), 9) AS chance FROM r""")
def a9_chance_level(spark, sf_dir):
    return metrics.chance_level(table(spark, sf_dir, "events"), "event_type", "user_id").select(F.round("chance", 9).alias("chance"))


@query(f"""WITH {PRED_SQL}, f AS (SELECT relation, gold_len AS fact, max(correct) AS c FROM pred GROUP BY ALL)
SELECT relation, CAST(sum(c) AS BIGINT) AS n_correct, count(*) AS n_facts, round(sum(c) / (count(*) + 1e-10), 6) AS oracle FROM f GROUP BY relation""")
def a7_oracle_accuracy(spark, sf_dir):
    return rounded(metrics.oracle_accuracy(predictions(spark, sf_dir), "relation", "gold_len"), "oracle")


@query(f"""WITH {PRED_SQL}, a AS (SELECT lang, seed, avg(correct) AS m FROM pred GROUP BY ALL)
SELECT lang, round(avg(m), 6) AS em_mean, round(stddev_samp(m), 6) AS em_std, count(m) AS n_groups FROM a GROUP BY lang""")
def a13_seed_mean(spark, sf_dir):
    return rounded(metrics.two_level(predictions(spark, sf_dir), ["lang"], ["seed"], "correct", "em"), "em_mean", "em_std")


@query(f"""WITH {PRED_SQL}, a AS (SELECT seed, relation, avg(correct) AS m FROM pred GROUP BY ALL)
SELECT seed, round(avg(m), 6) AS em_mean, round(stddev_samp(m), 6) AS em_std, count(m) AS n_groups FROM a GROUP BY seed""")
def a21_relation_em(spark, sf_dir):
    return rounded(metrics.two_level(predictions(spark, sf_dir), ["seed"], ["relation"], "correct", "em"), "em_mean", "em_std")


@query(f"""WITH {LANGS_SQL}, l AS (SELECT count(DISTINCT lang) AS l FROM facts), p AS (SELECT seed, fact, count(*) AS n, sum(correct) AS k FROM facts GROUP BY ALL),
h AS (SELECT seed, k, count(*) AS n FROM p, l WHERE p.n = l GROUP BY ALL), b AS (SELECT seed, unnest(range(0, l + 1)) AS k FROM (SELECT DISTINCT seed FROM h), l)
SELECT b.seed, CAST(b.k AS INTEGER) AS k, coalesce(h.n, 0) AS n, round(coalesce(h.n, 0) / sum(coalesce(h.n, 0)) OVER (PARTITION BY b.seed), 6) AS share FROM b LEFT JOIN h ON b.seed = h.seed AND b.k = h.k""")
def a17_overlap_histogram(spark, sf_dir):
    return rounded(metrics.overlap_histogram(language_facts(spark, sf_dir), "fact", "lang", ["seed"]), "share")


@query(f"""WITH {LANGS_SQL} SELECT a.seed, a.lang AS lang_a, b.lang AS lang_b, CAST(sum(a.correct * b.correct) AS BIGINT) AS n_both, CAST(sum(greatest(a.correct, b.correct)) AS BIGINT) AS n_any, count(*) AS n,
round(sum(a.correct * b.correct) / nullif(sum(greatest(a.correct, b.correct)), 0), 6) AS jaccard FROM facts a JOIN facts b ON a.fact = b.fact AND a.seed = b.seed AND a.lang < b.lang GROUP BY ALL""")
def a18_jaccard(spark, sf_dir):
    return rounded(metrics.pairwise_overlap(language_facts(spark, sf_dir), "fact", "lang", ["seed"]), "jaccard")


@query(f"""WITH {LANGS_SQL}, p AS (SELECT fact, count(DISTINCT lang) AS n_langs FROM facts WHERE correct = 1 GROUP BY fact)
SELECT n_langs, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM p GROUP BY n_langs""")
def a20_language_counts(spark, sf_dir):
    return rounded(metrics.language_count_distribution(language_facts(spark, sf_dir), "fact", "lang"), "share")


@query(f"""WITH {LANGS_SQL}, b AS (SELECT DISTINCT fact FROM facts WHERE lang = 'NO' AND correct = 1)
SELECT seed, lang, round(avg(correct), 6) AS p_given, count(*) AS n FROM facts SEMI JOIN b USING (fact) WHERE lang <> 'NO' GROUP BY seed, lang""")
def a16_transfer_given(spark, sf_dir):
    return rounded(metrics.transfer_given(language_facts(spark, sf_dir), "fact", "lang", "NO", ["seed"]), "p_given")


@query(f"""WITH {PRED_SQL}, o AS (SELECT lang, fact, min(gold_len) AS n, max(other) AS s FROM pred GROUP BY ALL)
SELECT lang, round(avg(n), 6) AS mean_tokens, round(avg(CASE WHEN n > 1 THEN 1 ELSE 0 END), 6) AS share_multi, CAST(sum(s) AS BIGINT) AS n_scored, CAST(sum(1 - s) AS BIGINT) AS n_skipped FROM o GROUP BY lang""")
def a15_fertility(spark, sf_dir):
    return rounded(metrics.fertility(predictions(spark, sf_dir), ["fact"], ["lang"], scored="other"), "mean_tokens", "share_multi")


@query("""WITH h AS (SELECT l_linenumber AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(1, 11) t(b) LEFT JOIN h ON bin = b""")
def a3_zero_filled_histogram(spark, sf_dir):
    return metrics.zero_filled_histogram(table(spark, sf_dir, "lineitem"), "l_linenumber", 10)


@query(f"""WITH {PRED_SQL}, p AS (SELECT lang, relation, count(*) AS n FROM pred GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS n_facts, count(*) AS n_relations, min(n) AS min_facts, max(n) AS max_facts, round(sum(n) / 1000, 6) AS coverage FROM p GROUP BY lang""")
def a1_language_coverage(spark, sf_dir):
    return rounded(metrics.language_coverage(predictions(spark, sf_dir), "lang", "relation", 1000), "coverage")


@query(f"""WITH {PRED_SQL} SELECT lang, count(*) AS n, round(avg(gold_len), 6) AS mean_len, count(*) FILTER (gold_len <= 100) AS n_short, count(*) FILTER (gold_len > 100) AS n_long FROM pred GROUP BY lang""")
def a2_length_summary(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg("gold_len")).alias("mean_len"), F.count(F.when(F.col("gold_len") <= 100, 1)).alias("n_short"), F.count(F.when(F.col("gold_len") > 100, 1)).alias("n_long"))


@query(f"""WITH {PRED_SQL} SELECT relation, count(*) AS total, count(*) FILTER (seed = 0) AS n_0, count(*) FILTER (seed = 1) AS n_1, count(*) FILTER (seed = 2) AS n_2 FROM pred GROUP BY relation""")
def a48_counts_by_part(spark, sf_dir):
    return metrics.counts_by_part(predictions(spark, sf_dir), "relation", "seed", [0, 1, 2])


@query(f"""WITH {PRED_SQL}, a AS (SELECT lang, seed, avg(correct) AS em FROM pred GROUP BY ALL)
SELECT a.lang, a.seed, round(a.em, 6) AS em, round(a.em - b.em, 6) AS gain FROM a LEFT JOIN a b ON a.lang = b.lang AND b.seed = 0""")
def a12_gains(spark, sf_dir):
    em = predictions(spark, sf_dir).groupBy("lang", "seed").agg(F.avg("correct").alias("em"))
    return rounded(metrics.gains(em, ["lang"], "seed", 0, "em"), "em", "gain")


@query(f"""WITH {PRED_SQL} SELECT relation, count(*) FILTER (correct = 1 AND other <> 1) AS wins, count(*) FILTER (correct <> 1 AND other = 1) AS losses,
count(*) FILTER (correct = 1 AND other = 1) AS both, count(*) FILTER (correct <> 1 AND other <> 1) AS neither FROM pred GROUP BY relation""")
def a28_win_loss(spark, sf_dir):
    return metrics.win_loss(predictions(spark, sf_dir), "relation", "correct", "other")


@query(f"""WITH {PRED_SQL}, r AS (SELECT correct, (row_number() OVER (PARTITION BY relation ORDER BY gold_len, fact) - 1) / count(*) OVER (PARTITION BY relation) AS r FROM pred)
SELECT CAST(least(floor(r * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM r WHERE correct = 1 GROUP BY 1""")
def a30_normalised_ranks(spark, sf_dir):
    return metrics.normalised_ranks(predictions(spark, sf_dir), "relation", ["gold_len", "fact"], "correct")


@query(f"WITH {PRED_SQL} SELECT v AS label, count(*) FILTER (correct = v AND other = 0) AS n_0, count(*) FILTER (correct = v AND other = 1) AS n_1, count(*) FILTER (correct = v AND other = 2) AS n_2 FROM pred, (VALUES (0), (1), (2)) t(v) GROUP BY v")
def a33_confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), "correct", "other", [0, 1, 2])


@query(f"WITH {PRED_SQL} SELECT lang, correct, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM pred GROUP BY lang, correct")
def a34_crosstab(spark, sf_dir):
    return rounded(metrics.crosstab_shares(predictions(spark, sf_dir), "lang", "correct"), "share")


@query("""WITH b AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 32 AS b, CASE WHEN value > 50 THEN 1 ELSE 0 END AS h, 1 + event_id % 5 AS t FROM events), p AS (SELECT b, sum(h) AS h, sum(t) AS t FROM b GROUP BY b)
SELECT round(avg(h / t), 6) AS batch_mean, round(sum(h) / sum(t), 6) AS micro FROM p""")
def a11_token_accuracy(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 50, 1).otherwise(0).alias("hit"), (1 + F.col("event_id") % 5).alias("n"))
    return rounded(metrics.token_accuracy(x, ["event_id"], 32, "hit", "n"), "batch_mean", "micro")


_PAIRS = "count(*) FILTER (correct = 1 AND other <> 1) AS only_a, count(*) FILTER (correct <> 1 AND other = 1) AS only_b"


@query(f"""WITH {LANGS_SQL}, x AS (SELECT a.relation, a.correct, b.correct AS other FROM facts a JOIN facts b ON a.fact = b.fact AND a.lang = 'AF' AND b.lang = 'RF'),
p AS (SELECT relation, {_PAIRS} FROM x GROUP BY relation), n AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS k FROM p)
SELECT relation, only_a, only_b, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))) END, 6) AS p_value FROM n""")
def a24_mcnemar(spark, sf_dir):
    x = language_facts(spark, sf_dir).where("lang IN ('AF', 'RF')").groupBy("relation", "fact").agg(F.max(F.when(F.col("lang") == "AF", F.col("correct"))).alias("a"), F.max(F.when(F.col("lang") == "RF", F.col("correct"))).alias("b"))
    return rounded(stats.mcnemar(x.where("a IS NOT NULL AND b IS NOT NULL"), ["relation"], "a", "b"), "p_value")


_CONF = "conf AS (SELECT l_returnflag AS grp, l_discount * 10 AS confidence, CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END AS correct FROM lineitem)"


def _confidence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_tax") >= 0.04, 1).otherwise(0).alias("correct"))


@query(f"""WITH {_CONF} SELECT grp, CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(correct), 6) AS accuracy FROM conf GROUP BY 1, 2""")
def a26_calibration_bins(spark, sf_dir):
    return rounded(stats.calibration_bins(_confidence(spark, sf_dir), ["grp"], "confidence", "correct"), "confidence", "accuracy")


@query(f"""WITH {_CONF}, b AS (SELECT grp, least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM conf GROUP BY 1, 2)
SELECT grp, round(sum(n * abs(c - a)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY grp""")
def a26_ece(spark, sf_dir):
    return rounded(stats.expected_calibration_error(_confidence(spark, sf_dir), ["grp"], "confidence", "correct"), "ece")


@query(f"""WITH {PRED_SQL}, k AS (SELECT lang, count(*) AS n, count(*) FILTER (correct = other) / count(*) AS po,
(count(*) FILTER (correct = 0) * count(*) FILTER (other = 0) + count(*) FILTER (correct = 1) * count(*) FILTER (other = 1)) / (count(*) * count(*)) AS pe FROM pred GROUP BY lang)
SELECT lang, n, round(po, 6) AS agreement, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM k""")
def a31_kappa(spark, sf_dir):
    return rounded(stats.cohen_kappa(predictions(spark, sf_dir), ["lang"], "correct", "other", [0, 1]), "agreement", "kappa")


@query(f"""WITH {PRED_SQL} SELECT coalesce(lang, 'all') AS lang, count(*) AS n, round(avg(CASE WHEN correct = other THEN 1 ELSE 0 END), 6) AS agreement FROM pred GROUP BY GROUPING SETS ((), (lang))""")
def a32_agreement(spark, sf_dir):
    x = predictions(spark, sf_dir).rollup("lang").agg(F.count("*").alias("n"), r6(F.avg((F.col("correct") == F.col("other")).cast("int"))).alias("agreement"))
    return x.withColumn("lang", F.coalesce("lang", F.lit("all")))


@query()
def a23_bootstrap(spark, sf_dir):
    return stats.bootstrap_difference(predictions(spark, sf_dir), ["lang"], "relation", "other", "correct")


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), e AS (SELECT *, CAST(1000 AS DOUBLE) * n / sum(n) OVER () AS e FROM c),
q AS (SELECT *, floor(e) AS q, row_number() OVER (ORDER BY e - floor(e) DESC, event_type) AS r, 1000 - sum(floor(e)) OVER () AS rest FROM e)
SELECT event_type, n, CAST(q + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q""")
def w1_quota(spark, sf_dir):
    return splits.largest_remainder(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n", 1000)


@query("""WITH x AS (SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY md5('7|' || event_id), event_id) AS r FROM events)
SELECT event_type, event_id, CASE WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part FROM x""")
def w2_split(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 7)


@query("""SELECT event_id, CASE WHEN CAST('0x' || substr(md5('3|' || event_id), 1, 4) AS INTEGER) < 6553 THEN 'val' ELSE 'train' END AS part FROM events""")
def w3_random_split(spark, sf_dir):
    return splits.random_split(table(spark, sf_dir, "events").select("event_id"), "event_id", 3, 0.1)


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), e AS (SELECT *, CAST(200 AS DOUBLE) * n / sum(n) OVER () AS e FROM c),
q AS (SELECT *, floor(e) AS q, row_number() OVER (ORDER BY e - floor(e) DESC, event_type) AS r, 200 - sum(floor(e)) OVER () AS rest FROM e),
x AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('1|' || event_id), event_id) AS rn FROM events)
SELECT x.event_type, x.event_id FROM x JOIN q ON x.event_type = q.event_type WHERE rn <= q.q + CASE WHEN r <= rest THEN 1 ELSE 0 END""")
def w4_take_quota(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "event_id")
    quotas = splits.largest_remainder(events.groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n", 200)
    return splits.take_quota(events, "event_type", "event_id", quotas, 1)


@query("""SELECT event_type, event_id, (['en', 'nl', 'ru', 'ko'])[1 + (row_number() OVER (ORDER BY event_type, md5('5|' || event_id), event_id) - 1) % 4] AS hand FROM events""")
def w5_round_robin(spark, sf_dir):
    return splits.round_robin(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 5, ["en", "nl", "ru", "ko"])


@query("""WITH m AS (SELECT min(floor(n / 4)) AS m FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)),
x AS (SELECT lang, doc_id, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY md5('2|' || doc_id), doc_id) - 1) / 4) AS INTEGER) AS batch FROM documents)
SELECT lang, doc_id, batch FROM x, m WHERE batch < m""")
def w6_balanced_batches(spark, sf_dir):
    return splits.balanced_batches(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 2, 4)


@query("""WITH x AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5('9|' || doc_id), doc_id) AS r FROM documents) SELECT lang, source, doc_id FROM x WHERE r <= 3""")
def w7_sample_per_group(spark, sf_dir):
    return splits.sample_per_group(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id", 3, 9)


@query(f"""WITH {PRED_SQL} SELECT relation, arg_max(fact, (correct * 1000000 + gold_len) * 10000000 - fact) AS fact FROM pred GROUP BY relation""")
def w11_argmax_first(spark, sf_dir):
    x = predictions(spark, sf_dir).withColumn("score", F.col("correct") * 1000000 + F.col("gold_len"))
    return ranking.argmax_first(x, ["relation"], "score", "fact", ["fact"])


@query("""WITH x AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS r FROM events)
SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS index FROM x WHERE r = 1""")
def w13_dedupe_candidates(spark, sf_dir):
    x = ranking.dedupe_candidates(table(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), "event_type", "user_id", "event_id")
    return x.withColumn("index", F.col("index").cast("long"))


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL""")
def w14_drop_duplicates_first(spark, sf_dir):
    return ranking.drop_duplicates_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


_CURVE = "curve AS (SELECT user_id AS run, event_id AS epoch, CAST((event_id * 7919) % 97 AS DOUBLE) AS v FROM events)"


def _curve(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), ((F.col("event_id") * 7919) % 97).cast("double").alias("v"))


@query(f"""WITH {_CURVE}, x AS (SELECT run, epoch, v, first_value(v) OVER w AS f, last_value(v) OVER w AS l FROM curve
WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT run, epoch, round((v - l) / CASE WHEN f = l THEN 1.0 ELSE f - l END, 6) AS relative FROM x""")
def w20_relative_to_ends(spark, sf_dir):
    return rounded(ranking.relative_to_ends(_curve(spark, sf_dir), ["run"], ["epoch"], "v"), "relative").drop("v")


@query("""WITH x AS (SELECT lang, doc_id, -ln((CAST('0x' || substr(md5('4|' || doc_id), 1, 8) AS BIGINT) + 1) / CAST(4294967297 AS DOUBLE)) / n_chars AS k FROM documents WHERE n_chars > 0),
y AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) AS r FROM x) SELECT lang, doc_id FROM y WHERE r <= 5""")
def w21_weighted_sample(spark, sf_dir):
    return splits.weighted_sample(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], "doc_id", "n_chars", 5, 4).select("lang", "doc_id")


@query(f"""WITH {_CURVE}, b AS (SELECT run, epoch, v, min(v) OVER (PARTITION BY run ORDER BY epoch) AS best, min(v) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM curve),
c AS (SELECT *, epoch - max(CASE WHEN prev IS NULL OR v < prev THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS since FROM b)
SELECT run, epoch, v, best, since, max(CASE WHEN since >= 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) = 1 AS stopped FROM c""")
def w22_running_best(spark, sf_dir):
    return ranking.running_best(_curve(spark, sf_dir), ["run"], "epoch", "v", 2000)


@query("""WITH s AS (SELECT l_orderkey AS example, l_suppkey AS candidate, -l_extendedprice AS score, l_linenumber AS len, 'R' || (l_orderkey % 7) AS relation, l_partkey % 100 AS gold FROM lineitem),
x AS (SELECT *, a AS alpha, score / pow(CAST(len AS DOUBLE), a) AS v FROM s, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) t(a)),
r AS (SELECT *, row_number() OVER (PARTITION BY alpha, relation, example ORDER BY v DESC, candidate) AS r FROM x), p AS (SELECT alpha, relation, avg(CASE WHEN candidate % 10 = gold % 10 THEN 1 ELSE 0 END) AS m FROM r WHERE r = 1 GROUP BY ALL)
SELECT alpha, round(avg(m), 6) AS macro FROM p GROUP BY alpha""")
def m7_alpha_sweep(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    x = x.select(F.col("l_orderkey").alias("example"), F.col("l_suppkey").alias("candidate"), (-F.col("l_extendedprice")).alias("score"), F.col("l_linenumber").alias("len"), F.concat(F.lit("R"), (F.col("l_orderkey") % 7).cast("string")).alias("relation"), (F.col("l_partkey") % 100).alias("gold"))
    v = x.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in (0, 0.5, 1)])))
    v = v.withColumn("v", ranking.length_normalised(F.col("score"), F.col("len"), F.col("alpha")))
    top = ranking.argmax_first(v.withColumn("hit", (F.col("candidate") % 10 == F.col("gold") % 10).cast("int")), ["alpha", "relation", "example"], "v", "candidate", ["hit"])
    return rounded(top.groupBy("alpha", "relation").agg(F.avg("hit").alias("m")).groupBy("alpha").agg(F.avg("m").alias("macro")), "macro")


@query("""SELECT lang FROM (SELECT lang, source, count(*) FROM documents GROUP BY ALL) GROUP BY lang""")
def u9_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang").distinct()


@query(f"WITH {LANGS_SQL} SELECT fact FROM facts GROUP BY fact HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM facts)")
def u1_in_all_languages(spark, sf_dir):
    return splits.in_all(language_facts(spark, sf_dir), ["fact"], "lang")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_parts FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def u3_shared_keys(spark, sf_dir):
    return splits.shared_keys(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u4_missing(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT o_orderpriority, round(avg(exp(-o_totalprice / 500000)), 6) AS confidence, round(exp(avg(ln(o_totalprice))), 2) AS perplexity FROM orders GROUP BY o_orderpriority""")
def a58_perplexity(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(r6(F.avg(F.exp(-F.col("o_totalprice") / 500000))).alias("confidence"), F.round(F.exp(F.avg(F.log("o_totalprice"))), 2).alias("perplexity"))


@query(f"""WITH {_CURVE}, x AS (SELECT run, arg_max(v, epoch) AS last, max(v) AS top, arg_min(epoch, -v * 100000000 + epoch) AS best_epoch FROM curve GROUP BY 1)
SELECT run, last < 0.5 * top AS collapsed, best_epoch FROM x""")
def a52_collapse(spark, sf_dir):
    x = _curve(spark, sf_dir).groupBy("run").agg(F.max_by("v", "epoch").alias("last"), F.max("v").alias("top"), F.max_by("epoch", F.struct("v", -F.col("epoch"))).alias("best_epoch"))
    return x.select("run", (F.col("last") < 0.5 * F.col("top")).alias("collapsed"), "best_epoch")


@query("""SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS u0, count(*) FILTER (user_id % 3 = 1) AS u1, count(*) FILTER (user_id % 3 = 2) AS u2 FROM events GROUP BY event_type""")
def a54_pivot(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("g", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))
    return x.groupBy("event_type").pivot("g", ["u0", "u1", "u2"]).count().na.fill(0)


@query("""SELECT lang, round(2.0 * a * b / nullif(a + b, 0), 6) AS harmonic FROM (SELECT lang, count(*) FILTER (n_chars > 1000) AS a, count(*) FILTER (n_chars <= 1000) AS b FROM documents GROUP BY lang)""")
def a40_harmonic_mean(spark, sf_dir):
    a, b = F.count(F.when(F.col("n_chars") > 1000, 1)), F.count(F.when(F.col("n_chars") <= 1000, 1))
    x = table(spark, sf_dir, "documents").groupBy("lang").agg(a.alias("a"), b.alias("b"))
    return x.select("lang", r6(2.0 * F.col("a") * F.col("b") / F.when(F.col("a") + F.col("b") > 0, F.col("a") + F.col("b"))).alias("harmonic"))


@query("""SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS p FROM events GROUP BY user_id, event_type""")
def a42_alias_probabilities(spark, sf_dir):
    return rounded(metrics.crosstab_shares(table(spark, sf_dir, "events"), "user_id", "event_type").withColumnRenamed("share", "p"), "p")


_LEN = "CASE WHEN fact % 3 = 0 THEN '1' WHEN fact % 3 = 1 THEN '2-3' ELSE '4+' END"


@query(f"""WITH {LANGS_SQL}, b AS (SELECT seed, fact FROM facts WHERE lang = 'NO' AND correct = 1), x AS (SELECT seed, lang, fact, correct, {_LEN} AS bucket FROM facts WHERE lang <> 'NO'),
p AS (SELECT seed, lang, bucket, avg(correct) AS p, count(*) AS n FROM x SEMI JOIN b USING (seed, fact) GROUP BY ALL),
g AS (SELECT l.seed, l.lang, k.bucket FROM (SELECT DISTINCT seed, lang FROM x) l, (SELECT unnest(['1', '2-3', '4+', '9+']) AS bucket) k)
SELECT lang, bucket, round(avg(p), 6) AS p_mean, round(stddev_samp(p), 6) AS p_std, round(avg(coalesce(n, 0)), 6) AS n FROM g LEFT JOIN p USING (seed, lang, bucket) GROUP BY ALL""")
def a16_transfer_by_bucket(spark, sf_dir):
    k = F.col("fact") % 3
    x = language_facts(spark, sf_dir).withColumn("bucket", F.when(k == 0, "1").when(k == 1, "2-3").otherwise("4+"))
    return rounded(metrics.transfer_by_bucket(x, ["fact"], "lang", "NO", [], "seed", "bucket", ["1", "2-3", "4+", "9+"]), "p_mean", "p_std", "n")


@query("""WITH facts AS (SELECT l_orderkey AS fact, l_returnflag AS lang, max(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS correct, l_orderkey % 3 AS seed FROM lineitem GROUP BY ALL),
w AS (SELECT seed, fact FROM facts GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)), f AS (SELECT * FROM facts SEMI JOIN w USING (seed, fact)),
j AS (SELECT a.seed, a.lang AS lang_a, b.lang AS lang_b, sum(a.correct * b.correct) / nullif(sum(greatest(a.correct, b.correct)), 0) AS jaccard FROM f a JOIN f b ON a.seed = b.seed AND a.fact = b.fact AND a.lang < b.lang GROUP BY ALL)
SELECT lang_a, lang_b, round(avg(jaccard), 6) AS jaccard_mean FROM j GROUP BY ALL""")
def a18_complete_jaccard(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fact"), F.col("l_returnflag").alias("lang")).agg(F.max(F.when(F.col("l_discount") >= 0.05, 1).otherwise(0)).alias("correct"))
    return rounded(metrics.complete_jaccard(x.withColumn("seed", F.col("fact") % 3), "fact", "lang", [], "seed"), "jaccard_mean")


@query("""WITH c AS (SELECT l_returnflag AS grp, (l_partkey % 100) / 100.0 AS confidence, CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END AS correct, unnest(['all', CASE WHEN l_linenumber <= 1 THEN 'single' ELSE 'multi' END]) AS stratum FROM lineitem),
b AS (SELECT grp, stratum, least(floor(CAST(confidence AS DOUBLE) * 10), 9) AS bin, count(*) AS n, avg(CAST(confidence AS DOUBLE)) AS c, avg(correct) AS a FROM c GROUP BY ALL)
SELECT grp, stratum, round(sum(n * abs(c - a)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) = 10 THEN round(sum(n * abs(c - a)) / sum(n), 6) END AS ece_strict FROM b GROUP BY ALL""")
def a26_ece_by_stratum(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), ((F.col("l_partkey") % 100) / 100.0).alias("confidence"), F.when(F.col("l_tax") >= 0.04, 1).otherwise(0).alias("correct"), "l_linenumber")
    return rounded(stats.calibration_by_stratum(x, ["grp"], "confidence", "correct", "l_linenumber"), "ece", "ece_strict")


WIDTH, LINES = 3, 7  # an order has at most seven lines
_STEP = """, b{p} AS (SELECT example, tokens, score FROM (
  SELECT b.example, CASE WHEN s.token IS NULL THEN b.tokens ELSE list_append(b.tokens, s.token) END AS tokens, max(b.score + coalesce(s.score, 0)) AS score
  FROM b{q} b LEFT JOIN s ON s.example = b.example AND s.position = {p} AND s.prev IS NOT DISTINCT FROM b.tokens[-1] GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY example ORDER BY score DESC, tokens) <= {k})"""


@query(f"""WITH t AS (SELECT l_orderkey AS o, l_linenumber AS position, l_returnflag || l_linestatus AS token, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
s AS (SELECT o_custkey AS example, t.position, before.token AS prev, t.token, CAST(sum(t.q) AS BIGINT) AS score
  FROM t JOIN orders ON o_orderkey = t.o LEFT JOIN t before ON before.o = t.o AND before.position = t.position - 1 GROUP BY ALL),
b0 AS (SELECT DISTINCT example, CAST([] AS VARCHAR[]) AS tokens, CAST(0 AS BIGINT) AS score FROM s){"".join(_STEP.format(p=p, q=p - 1, k=WIDTH) for p in range(1, LINES + 1))}
SELECT example, row_number() OVER (PARTITION BY example ORDER BY score DESC, tokens) AS rank, array_to_string(tokens, '>') AS tokens, CAST(score AS BIGINT) AS score FROM b{LINES}""")
def w25_beam(spark, sf_dir):
    """Each customer's weightiest runs of flag and status along an order's lines: a line number a position, the quantity of each step its score."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("position"), F.concat("l_returnflag", "l_linestatus").alias("token")).agg(F.sum("l_quantity").alias("q"))
    before = t.select("o", (F.col("position") + 1).alias("position"), F.col("token").alias("prev"))
    customer = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("example"))
    x = t.join(before, ["o", "position"], "left").join(customer, "o").groupBy("example", "position", "prev", "token").agg(F.sum("q").cast("long").alias("score"))
    return ranking.beam(x, WIDTH).withColumn("tokens", F.array_join("tokens", ">"))
