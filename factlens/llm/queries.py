"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, maxscore, media, near, packing, pieces, quality, ranked, sharding, simple8b, substring, toxicity, trie
from .common import documents, id_crc
from .tokens import vocabulary_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return maxscore.top_k(vectors, vectors.where(F.col("id") % 20 == 0))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(documents(spark, sf_dir)).drop("error")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.encode_and_read(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"))


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicate_classes(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_html, op4_maxscore, op5_substring, op6_media, op7_sharding, op8_simple8b, op9_near, op10_sentencepiece, op11_ranked, op12_quality, op13_trie)}

SQL: dict[str, str] = {
    "op4_maxscore": """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.id % 20 = 0 AND c.id <> q.id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op5_substring": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE doc_id IS NOT NULL AND len(ws) >= 50)),
seen AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN seen USING (g) WHERE lo < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE doc_id IN (SELECT doc_id FROM gone)),
kept AS (SELECT doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL), '') AS kept FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, array_to_string(ws, ' '))) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op7_sharding": """
WITH t AS (SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) r(n)),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, size, xor(4294967295, list_reduce([4294967295] || list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda c, b: xor(t.crc[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32 FROM d, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM x),
s AS (SELECT *, CAST(least(15, ((before * 2 + size) * 16) // (total * 2)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
""",
    "op11_ranked": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS t FROM documents),
items AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_all FROM docs WHERE len(t) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM docs) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY term, n_docs),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_all)))) AS BIGINT) AS score FROM items JOIN tf USING (term) JOIN w USING (term), c GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
""",
    "op13_trie": """
WITH t AS (SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) r(n)),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce("text", '') AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce("text", ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM turns),
h AS (SELECT c, xor(4294967295, list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(CAST(c AS VARCHAR))), '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda c, b: xor(t.crc[(xor(c, b) & 255) + 1], c >> 8))) % 6 AS h FROM ids, t),
parts AS (
  SELECT h.c, 0 AS part, i, role, txt FROM h JOIN turns ON turns.c = h.c - h.c % 100 AND i < h
  UNION ALL SELECT h.c, 1, i, role, txt FROM h JOIN turns ON turns.c = h.c AND i >= h),
seqs AS (SELECT ids.c, coalesce(x, []) AS x FROM ids LEFT JOIN (SELECT c, list({'r': role, 't': txt} ORDER BY part, i) AS x FROM parts GROUP BY c) s ON s.c = ids.c),
pre AS (SELECT c, d, x[:d] AS p, d = len(x) AS is_end FROM (SELECT c, x, unnest(range(0, len(x) + 1)) AS d FROM seqs)),
nodes AS (SELECT min(c) AS conv_id, d AS depth, p, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(p)[d].t) END AS saved FROM pre GROUP BY d, p),
kids AS (SELECT depth - 1 AS depth, p[:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
family AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.depth = nodes.depth AND kids.p = nodes.p),
below AS (SELECT u.depth, u.p, sum(f.saved) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves FROM (SELECT unnest(range(0, depth + 1)) AS up, * FROM family) f JOIN nodes u ON u.depth = f.up AND u.p = f.p[:f.up] GROUP BY ALL)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM family f JOIN below b ON b.depth = f.depth AND b.p = f.p LEFT JOIN nodes q ON q.depth = f.depth - 1 AND q.p = f.p[:f.depth - 1]
""",
}
