"""Joining a sample of ids back to its source texts, with validation of every match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.stable import sha256
from textloom.operators.ingest import column, label_of_model, none_if_empty, raw_text

COMPARED = ("model", "domain", "attack", "decoding", "repetition_penalty")
#: A sample of up to so many rows is sent to the tasks; a larger one is left to the optimizer.
MAX_BROADCAST_ROWS = 200_000


def join_texts(raw: DataFrame, assignments: DataFrame) -> DataFrame:
    """Matches of raw ids and assignments: label, group and split from the assignment, text and metadata from the row."""
    text = raw_text(raw)
    probe = raw.select(
        F.col("id").cast("string").alias("record_id"),
        text.alias("text"),
        *[none_if_empty(column(raw, c)).alias(c) for c in ("source_id", "adv_source_id", *COMPARED)],
        label_of_model(F.coalesce(F.col("model"), F.lit(""))).alias("raw_label"),
        F.length(text).alias("text_length"),
        sha256(text).alias("text_hash"),
    )
    side = assignments.select("record_id", F.col("label").cast("int").alias("label"), "group_id", "split", F.struct(*[none_if_empty(column(assignments, c)).alias(c) for c in (*COMPARED, "text_hash")]).alias("expected"))
    if side.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        side = F.broadcast(side)
    return probe.join(side, "record_id")


def mismatches(joined: DataFrame) -> DataFrame:
    """(field, mismatches): null and empty are equal; a text hash counts only where one is expected."""
    differ = {c: F.coalesce(F.col(c), F.lit("")) != F.coalesce(F.col(f"expected.{c}"), F.lit("")) for c in COMPARED}
    differ["text_hash"] = F.col("expected.text_hash").isNotNull() & (F.col("text_hash") != F.col("expected.text_hash"))
    differ["label"] = F.col("raw_label") != F.col("label")
    total = joined.agg(*[F.count_if(c).alias(k) for k, c in differ.items()])
    return total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("mismatches")) for k in differ])).alias("x")).select("x.*")


def missing_ids(raw: DataFrame, assignments: DataFrame) -> DataFrame:
    return assignments.select("record_id").join(raw.select(F.col("id").cast("string").alias("record_id")), "record_id", "left_anti")


def repeated_ids(joined: DataFrame) -> DataFrame:
    return joined.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def id_sets_differ(ids: DataFrame, assignments: DataFrame) -> DataFrame:
    """(record_id, only_in) of ids that one side lacks."""
    a = ids.select("record_id").distinct().withColumn("a", F.lit(True))
    b = assignments.select("record_id").distinct().withColumn("b", F.lit(True))
    return a.join(b, "record_id", "full_outer").where("a is null or b is null").select("record_id", F.when(F.col("a").isNull(), "assignments").otherwise("ids").alias("only_in"))


def finished(joined: DataFrame) -> DataFrame:
    """The joined rows in their final columns; an absent attack is ``none``."""
    attack = F.coalesce(F.col("attack"), F.lit("none")).alias("attack")
    return joined.select("record_id", "text", "label", "group_id", "split", "source_id", "adv_source_id", "model", "domain", attack, "decoding", "repetition_penalty", "text_length", "text_hash")


def summary(done: DataFrame, assignments: DataFrame) -> dict:
    """What a report of a finished join says: rows asked for and joined, labels, and lengths of the texts."""
    labels = {str(r["label"]): r["n"] for r in done.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()}
    length = done.agg(F.min("text_length").alias("min"), F.max("text_length").alias("max"), F.round(F.avg("text_length"), 2).alias("mean")).first().asDict()
    return {"assignments": assignments.count(), "joined": sum(labels.values()), "labels": labels, "text_length": length, "mismatches": {}}


def validated(raw: DataFrame, assignments: DataFrame) -> DataFrame:
    """The joined rows, after all checks passed; fails on missing or repeated ids and on mismatches."""
    joined = join_texts(raw, assignments)
    lost = missing_ids(raw, assignments).orderBy("record_id").limit(5).collect()
    if lost:
        raise ValueError(f"assignments not found in the source: {[r['record_id'] for r in lost]}")
    again = repeated_ids(joined).limit(5).collect()
    if again:
        raise ValueError(f"ids that match twice: {[r['record_id'] for r in again]}")
    bad = mismatches(joined).where("mismatches > 0").collect()
    if bad:
        raise ValueError(f"joined rows differ from their assignments: {[r.asDict() for r in bad]}")
    return finished(joined)
