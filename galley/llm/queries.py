"""The registered queries of this subpackage; each reads its tables whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import (
    bpe,
    decontaminate,
    embeddings,
    hard_negatives,
    importance,
    lines,
    pages,
    pii,
    quality,
    secrets,
    simhash,
    substrings,
    toxicity,
)
from galley.llm.common import documents


def _decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf), items).drop("spans")


def _bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = documents(spark, sf).select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.digest_of_ids(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_dedup(documents(spark, sf))


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf}/pages.parquet"))


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return quality.classify(docs, model)


def _substrings(spark: SparkSession, sf: str) -> DataFrame:
    done = substrings.substring_dedup(documents(spark, sf))
    digest = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return done.select("doc_id", "n_words", "n_removed", digest)


def _pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.scan(documents(spark, sf))


def _secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(documents(spark, sf))


def _simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf))


def _hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def _importance(spark: SparkSession, sf: str) -> DataFrame:
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    return importance.resample_keys(documents(spark, sf), target).drop("th")


def _toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return toxicity.classify(docs, model)


def queries() -> dict:
    return {
        "op1_decontamination": _decontaminate,
        "op2_byte_bpe": _bpe,
        "op3_line_dedup": _line_dedup,
        "op4_embedding_near_dedup": _embeddings,
        "op5_html_extraction": _pages,
        "op6_quality_classifier": _quality,
        "op7_substring_dedup": _substrings,
        "op8_pii": _pii,
        "op9_secret_scan": _secrets,
        "op10_simhash_near_dedup": _simhash,
        "op11_hard_negatives": _hard_negatives,
        "op12_importance_resampling": _importance,
        "op13_toxicity": _toxicity,
    }


# --- the same results as SQL; the others are tested against brute force ---------

_DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS w, list_slice(words, i, i + 9) AS win
  FROM b, unnest(range(1, greatest(len(words) - 8, 2))) AS r(i) WHERE len(words) > 0
), dw AS (
  SELECT doc_id, i, w, list_slice(words, i, i + w - 1) AS win
  FROM d, (SELECT DISTINCT w FROM bw), unnest(range(1, len(words) - w + 2)) AS r(i) WHERE len(words) >= w
), hits AS (
  SELECT dw.doc_id, dw.i, dw.w, bw.item_id FROM dw JOIN bw USING (w, win)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, w)) AS r(k) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


_EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)
), links AS (
  SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id))::BIGINT AS component_id,
  least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


_SUBSTRINGS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), wins AS (
  SELECT doc_id, i, list_slice(words, i, i + 12) AS win FROM d, unnest(range(1, len(words) - 11)) AS r(i)
), firsts AS (
  SELECT win, min(doc_id) AS lowest FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM wins JOIN firsts USING (win), unnest(range(0, 13)) AS r(k) WHERE lowest < doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


_HARD_NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


# DuckDB has no crc32: bytes of a word fold over the table of the reversed polynomial
_IMPORTANCE = r"""
WITH steps AS (
  SELECT list(list_reduce([n::BIGINT] || list_transform(range(8), lambda x: x::BIGINT),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY n) AS turned
  FROM range(256) AS r(n)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), dw AS (SELECT word, count(*) AS s FROM (SELECT unnest(words) AS word FROM d) GROUP BY word),
bw AS (SELECT word, count(*) AS t FROM (SELECT unnest(words) AS word FROM b) GROUP BY word),
coded AS (
  SELECT word, coalesce(s, 0) AS s, coalesce(t, 0) AS t, hex(encode(word)) AS h FROM dw FULL JOIN bw USING (word)
), hashed AS (
  SELECT word, s, t, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda c, x: xor(c >> 8, steps.turned[xor(c & 255, x) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM coded, steps
), totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM hashed),
gain AS (
  SELECT bucket, floor(1000 * ln(((sum(t) + 1) * (all_s + 10000))::DOUBLE / ((sum(s) + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS g
  FROM hashed, totals GROUP BY bucket, all_s, all_t
), word_gain AS (SELECT word, g FROM hashed JOIN gain USING (bucket)),
summed AS (
  SELECT doc_id, sum(g) AS total FROM (SELECT doc_id, unnest(words) AS word FROM d) JOIN word_gain USING (word) GROUP BY doc_id
), weighed AS (
  SELECT doc_id, len(words)::BIGINT AS n_features,
    CASE WHEN len(words) = 0 THEN 0 ELSE floor(coalesce(total, 0) / len(words)) END::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN summed USING (doc_id)
), scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
), able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank
FROM scored LEFT JOIN able USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": _DECONTAMINATION,
        "op4_embedding_near_dedup": _EMBEDDINGS,
        "op7_substring_dedup": _SUBSTRINGS,
        "op11_hard_negatives": _HARD_NEGATIVES,
        "op12_importance_resampling": _IMPORTANCE,
    }
