"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import align, ann, bestfit, exactdedup, langid, negatives, packing, pieces, secrets, simhash, substrings, tokencounts, toxicity
from quantloom.llm.common import bucket_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), secrets.fit(spark))
    return found.select("doc_id", "start", "end", "kind", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.groups(_table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.cut_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    train = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic").where(bucket_of("doc_id", 5) != 0), "doc_id")
    out = toxicity.score(docs, toxicity.fit(train))
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and after the edits that mask its personal data."""
    return tokencounts.counts(tokencounts.with_masks(_table(spark, sf_dir, "documents")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    ids = pieces.encode(docs, carry=("text_sha256",))
    ids = ids.select("doc_id", "ids", "text_sha256", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    text = pieces.decode(ids, carry=("text_sha256", "n_tokens", "ids_crc32"))
    return text.select("doc_id", "n_tokens", "ids_crc32", (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(bucket_of("doc_id", 4) != 2))
    return langid.predict(docs, model).select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents")))


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_counts(_table(spark, sf_dir, "documents"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.digest(bestfit.pack(_table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.usable(_table(spark, sf_dir, "embeddings"))
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_simhash, op3_exact_dedup, op4_nearest, op5_substring_dedup, op6_toxicity, op7_token_counts, op8_sentencepiece, op9_language_id, op10_packing, op11_align_tokens, op12_best_fit, op13_hard_negatives)}
ORACLE_SQL = {
    "op3_exact_dedup": """
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t
            FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY t) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r""",
    "op13_hard_negatives": """
        WITH good AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        met AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   list_dot_product(a.v, b.v)::BIGINT AS score
            FROM good a JOIN good b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT * FROM met WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id,
               (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
               n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN met n ON n.anchor_id = p.anchor_id AND NOT n.same
        WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 3""",
}
