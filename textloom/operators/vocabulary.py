"""Words that set one class of texts apart from the other, and scoring by them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textloom.functions.measures import BATCH_BYTES, NAMES, append
from textloom.functions.text import words
from textloom.session import bound_batches, ship_package

#: A vocabulary of up to so many words is sent to the tasks (about 20 MB); top_k bounds it when it is fitted here.
MAX_WORDS = 200_000


def fit(rows: DataFrame, min_freq: int = 10, top_k: int = 1000, text: str = "text", label: str = "label") -> DataFrame:
    """(word, weight): log ratio of the smoothed shares in class 1 and class 0, the ``top_k`` largest, positive ones only.

    Smoothing counts all distinct words, also those rarer than ``min_freq``. Ties (to nine places) go by word.
    """
    one = rows.where(F.col(label).isin(0, 1)).select(F.col(label).alias("y"), F.explode(words(F.col(text), 3)).alias("word"))
    counts = one.groupBy("word").agg(F.count_if(F.col("y") == 0).alias("h"), F.count_if(F.col("y") == 1).alias("a"))
    total = counts.agg(F.sum("h").alias("H"), F.sum("a").alias("A"), F.count(F.lit(1)).alias("V")).first()
    if not total["H"] or not total["A"]:
        raise ValueError("both classes need words")
    H, A, V = (float(total[c]) for c in "HAV")
    weight = F.log2(((F.col("a") + 1) / F.lit(A + V)) / ((F.col("h") + 1) / F.lit(H + V)))
    ranked = counts.where(F.col("h") + F.col("a") >= min_freq).select("word", weight.alias("weight"))
    return ranked.orderBy(F.round("weight", 9).desc(), "word").limit(top_k).where("weight > 0")


def weights_of(vocabulary: DataFrame) -> dict[str, float] | None:
    """The vocabulary as a dictionary for the tasks, or None if it has over MAX_WORDS words."""
    found = vocabulary.select("word", "weight").limit(MAX_WORDS + 1).collect()
    return {r["word"]: r["weight"] for r in found} if len(found) <= MAX_WORDS else None


def score(rows: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``rows`` with pmi_score: the weights of a text's words over the number of words; 0 without words.

    A vocabulary of up to MAX_WORDS words goes to the tasks, so no text is shuffled. A larger one is joined: each
    distinct text's words are counted before they meet it. The columns come in the same order either way.
    """
    weights = weights_of(vocabulary)
    if weights is not None:
        return measured(rows, text, weights, False)
    full = F.coalesce(F.col(text).cast("string"), F.lit(""))
    id_ = F.md5(full.cast("binary"))
    texts = rows.select(id_.alias("__i"), full.alias("t")).groupBy("__i").agg(F.first("t").alias("t"))
    counts = texts.select("__i", F.explode(words(F.col("t"), 3)).alias("word")).groupBy("__i", "word").agg(F.count(F.lit(1)).alias("c"))
    scores = counts.join(vocabulary.select("word", "weight"), "word", "left").groupBy("__i").agg((F.sum(F.col("c") * F.coalesce("weight", F.lit(0.0))) / F.sum("c")).alias("pmi_score"))
    out = rows.withColumn("__j", id_).join(scores, F.col("__i") == F.col("__j"), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != "pmi_score"], F.coalesce("pmi_score", F.lit(0.0)).alias("pmi_score"))


def measured(rows: DataFrame, text: str, weights: dict[str, float] | None, measures: bool) -> DataFrame:
    """``rows`` with pmi_score (if there are weights) and burstiness, rttr, entropy (if asked for), words found once."""
    spark = rows.sparkSession
    new = ["pmi_score"] * (weights is not None) + list(NAMES) * measures
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in new])
    if not rows.isStreaming:
        bound_batches(spark, BATCH_BYTES)
    ship_package(spark)
    fields = [*rows.schema.fields, *[StructField(c, DoubleType()) for c in new]]
    return rows.mapInArrow(partial(append, at=rows.columns.index(text), weights=weights, measures=measures), StructType(fields))
