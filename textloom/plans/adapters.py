"""Views of the test tables in the schemas that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.stable import sha256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as raw records: models, attacks and lineage follow from the id, adv_source_id from the text's start."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    human = i % 4 == 0
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    odd = F.floor(i / 4) % 2
    return d.select(
        F.col("doc_id"),
        F.concat(F.lit("doc-"), F.lpad(i.cast("string"), 8, "0")).alias("id"),
        F.concat(F.lit("S"), F.floor(i / 4).cast("string")).alias("source_id"),
        F.concat(F.lit("A"), F.substring(sha256(F.substring("text", 1, 64)), 1, 16)).alias("adv_source_id"),
        pick(("human", "gpt2", "mistral", "mpt-chat"), i % 4).alias("model"),
        F.when(human, None).otherwise(pick(("greedy", "sampling"), odd)).alias("decoding"),
        F.when(human, None).otherwise(pick(("1.0", "1.2"), odd)).alias("repetition_penalty"),
        pick(("none", "whitespace", "upper_lower", "synonym", None), F.floor((i % 20) / 4)).alias("attack"),
        F.col("lang").alias("domain"),
        F.col("text").alias("generation"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as labelled texts: users are human (0), all others not (1)."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "text", F.when(F.col("role") == "user", 0).otherwise(1).alias("label"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with quality as the label."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(q.select("doc_id", F.col("quality").alias("label")), "doc_id")
