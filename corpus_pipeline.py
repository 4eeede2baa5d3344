"""A corpus pipeline of five stages: language, lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the next one's ``docs``.
All stages but the last return the columns of documents; their decisions take effect in the rows and texts they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe_codec, decontaminate, langid, line_dedup, minhash
from textloom.llm._common import table
from textloom.session import discard, materialise, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told; the model learns from the rows that aren't held out."""
    return langid.keep_identified(docs, langid.fit(langid.training(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that resemble an earlier line; one that has nothing else goes. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, min_words=1)
    out = out.where(~((F.size("removed") > 0) & ~F.col("text").rlike(r"\S")))
    n = F.when(F.size("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the token ids and of the text decoded from them."""
    return bpe_codec.round_trip(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]
#: Words, languages and tokens come from Unicode rules, learned tables and merges that SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others keep. A stage's tables go once its result is written, and a result goes once the
    next one is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as paths:
            docs = materialise(stage(spark, docs, sf_dir), name)
            paths.remove(docs._textloom_path)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
