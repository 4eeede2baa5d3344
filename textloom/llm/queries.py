"""The registered queries op1 to op10: thin digests of the operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe_codec, decontaminate, langid, line_dedup, minhash, neighbours, pii, quality, token_counts, warc
from textloom.llm._common import held_out, table
from textloom.session import new_path


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"), new_path(spark, "archives"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", "text")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.training(docs))
    out = langid.predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_warc, op2_minhash_near_dedup, op3_nearest_neighbours, op4_token_counts, op5_bpe_round_trip, op6_line_dedup, op7_pii_surrogates, op8_quality_ranking, op9_benchmark_decontamination, op10_language_id)}
ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h FROM p),
        x AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
          translate(concat(to_base(CAST('0x' || h[1:10] AS BIGINT), 32, 8), to_base(CAST('0x' || h[11:20] AS BIGINT), 32, 8),
            to_base(CAST('0x' || h[21:30] AS BIGINT), 32, 8), to_base(CAST('0x' || h[31:40] AS BIGINT), 32, 8)),
            '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
          CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> top THEN top END AS refers_to
        FROM x""",
    "op3_nearest_neighbours": """
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
        o AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
              FROM o q JOIN o c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
