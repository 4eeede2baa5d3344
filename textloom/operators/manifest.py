"""Exact dedup with quarantine of contradictory labels, lineage groups, and checks of a finished manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.stable import sha256, shard
from textloom.functions.text import is_blank
from textloom.operators.components import connected_components
from textloom.operators.ingest import raw_text
from textloom.session import materialise

SPLITS = ("train", "validation", "test")
DIMENSIONS = ("label", "model", "domain", "attack")


def kept(records: DataFrame, order: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """Of each text the first record in ``order``; texts with contradictory labels give none.

    The first record and the labels' range come from partial aggregation, so a text that fills a third of the rows is one
    row of each task before the exchange.
    """
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in records.columns if c != "text_hash"]), F.struct(*order))
    found = records.groupBy("text_hash").agg(first.alias("x"), F.min("label").alias("a"), F.max("label").alias("b")).where("a = b")
    return found.select(*[F.col(c) if c == "text_hash" else F.col("x")[c].alias(c) for c in records.columns])


def refuse_repeated_ids(records: DataFrame) -> None:
    """Fail if a record id repeats; an action, before anything is written."""
    again = records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if again:
        raise ValueError(f"record ids repeat: {[r['record_id'] for r in again]}")


def kept_in_arrival_order(records: DataFrame, position: str) -> DataFrame:
    """What a stream keeps that takes the first row of each text and gives it back at the text's first contradiction; ids
    that repeat are refused."""
    refuse_repeated_ids(records)
    return kept(records, (position,))


def _by_text(records: DataFrame) -> DataFrame:
    return records.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))


def stats(raw: DataFrame, records: DataFrame) -> DataFrame:
    """One row: rows_kept, empty_rows_removed, duplicate_texts_removed, conflicting_texts_removed, conflicting_rows_removed."""
    same = F.col("a") == F.col("b")
    total = _by_text(records).agg(
        F.count_if(same).alias("rows_kept"),
        F.coalesce(F.sum(F.when(same, F.col("n") - 1)), F.lit(0)).alias("duplicate_texts_removed"),
        F.count_if(~same).alias("conflicting_texts_removed"),
        F.coalesce(F.sum(F.when(~same, F.col("n"))), F.lit(0)).alias("conflicting_rows_removed"),
    )
    empty = raw.agg(F.count_if(is_blank(raw_text(raw))).alias("empty_rows_removed"))
    return total.join(F.broadcast(empty))  # two single rows


def stats_in_arrival_order(raw: DataFrame, records: DataFrame, position: str) -> DataFrame:
    """The same totals for a stream that keeps what it sees first: duplicates before a text's first contradiction count
    as duplicates, and all that follows the contradiction, with the row kept until then, as conflicting."""
    per = records.groupBy("text_hash", "label").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("p"))
    by_text = per.groupBy("text_hash").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("p")).alias("p"))  # a place for each label
    by_text = materialise(by_text.select("text_hash", "n", F.get("p", F.lit(1)).alias("broken")), "texts-by-label")
    broken = by_text.where("broken is not null").select("text_hash", "broken")
    before = records.select("text_hash", F.col(position).alias("at")).join(broken, "text_hash").where("at < broken").agg(F.count(F.lit(1)).alias("before"))
    sums = by_text.agg(
        F.count_if(F.col("broken").isNull()).alias("rows_kept"),
        F.count(F.lit(1)).alias("texts"),
        F.coalesce(F.sum(F.when(F.col("broken").isNull(), F.col("n"))), F.lit(0)).alias("whole"),
        F.count_if(F.col("broken").isNotNull()).alias("conflicting_texts_removed"),
        F.coalesce(F.sum(F.when(F.col("broken").isNotNull(), F.col("n"))), F.lit(0)).alias("split"),
    )
    total = sums.join(F.broadcast(before)).select(  # two single rows
        "rows_kept",
        (F.col("whole") + F.col("before") - F.col("texts")).alias("duplicate_texts_removed"),
        "conflicting_texts_removed",
        (F.col("split") - F.col("before") + F.col("conflicting_texts_removed")).alias("conflicting_rows_removed"),
    )
    seen = raw.agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(is_blank(raw_text(raw))).alias("empty_rows_removed"))
    return total.join(F.broadcast(seen))  # two single rows


def links(source: Column, adv: Column, record: Column) -> Column:
    """The vertices a record joins, named by kind so that equal ids of two kinds stay apart."""
    some = F.array_compact(F.array(F.when(source.isNotNull(), F.concat(F.lit("source:"), source)), F.when(adv.isNotNull(), F.concat(F.lit("adv:"), adv))))
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.concat(F.lit("record:"), record)))


def group_name(link: Column) -> Column:
    return F.concat(F.lit("group-"), F.substring(sha256(link), 1, 16))


def with_groups(records: DataFrame, lineage: DataFrame | None = None, bridge_texts: bool = False) -> DataFrame:
    """``records`` with group_id: the name of the smallest link of the record's component.

    ``lineage`` are the rows whose links count (default: the records themselves); ``bridge_texts`` also joins the links
    of rows with equal texts.
    """
    of = lambda df: df.withColumn("__links", links(F.col("source_id"), F.col("adv_source_id"), F.col("record_id")))
    rows = of(lineage if lineage is not None else records)
    first = F.col("__links")[0]
    edges = rows.select(first.alias("u"), F.explode("__links").alias("v"))
    if bridge_texts:
        edges = edges.union(rows.groupBy("text_hash").agg(F.min(first).alias("m")).join(rows.select("text_hash", first.alias("u")), "text_hash").select("m", "u"))
    found = connected_components(edges.distinct())
    named = materialise(found.select("vertex", group_name(F.col("component")).alias("group_id")), "groups")
    return of(records).join(named, F.col("__links")[0] == named.vertex).drop("__links", "vertex")


def group_stats(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("label") == 0).alias("human"), F.count_if(F.col("label") == 1).alias("ai"))


def leakage(split_rows: DataFrame) -> DataFrame:
    """(key, violations): values of each key that occur in more than one split; nulls don't count."""
    keys = ("group_id", "source_id", "adv_source_id", "text_hash")
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])
    by_value = split_rows.select("split", F.explode(cells).alias("c")).select("split", "c.*").groupBy("key", "value").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return by_value.groupBy("key").agg(F.count_if(F.col("value").isNotNull() & (F.col("a") != F.col("b"))).alias("violations"))


def split_classes(split_rows: DataFrame) -> DataFrame:
    """(split, has_both) of all three splits."""
    spark = split_rows.sparkSession
    names = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    found = split_rows.groupBy("split").agg((F.count_distinct("label") == 2).alias("has_both"))
    return F.broadcast(names).join(found, "split", "left").select("split", F.coalesce("has_both", F.lit(False)).alias("has_both"))


def distribution(split_rows: DataFrame) -> DataFrame:
    """(split, section, key, rows) of labels, models, domains and attacks, and the totals; all splits appear."""
    spark = split_rows.sparkSession
    cells = F.array(F.struct(F.lit("rows").alias("section"), F.lit("").alias("key")), *[F.struct(F.lit(d).alias("section"), F.col(d).cast("string").alias("key")) for d in DIMENSIONS])
    counts = split_rows.select("split", F.explode(cells).alias("c")).groupBy("split", "c.section", "c.key").agg(F.count(F.lit(1)).alias("rows"))
    groups = split_rows.groupBy("split").agg(F.count_distinct("group_id").alias("rows")).select("split", F.lit("groups").alias("section"), F.lit("").alias("key"), "rows")
    zero = spark.createDataFrame([(s, x, "", 0) for s in SPLITS for x in ("rows", "groups")], "split string, section string, key string, rows long")
    return counts.unionByName(groups).unionByName(zero).groupBy("split", "section", "key").agg(F.sum("rows").alias("rows"))


def validate(split_rows: DataFrame) -> None:
    """Fail if a key leaks between splits or a split lacks a class."""
    bad = leakage(split_rows).where("violations > 0").collect()
    if bad:
        raise ValueError(f"values occur in several splits: {[r.asDict() for r in bad]}")
    lack = split_classes(split_rows).where("not has_both").collect()
    if lack:
        raise ValueError(f"splits without both classes: {[r['split'] for r in lack]}")


def with_shards(split_rows: DataFrame, shards: int = 32) -> DataFrame:
    return split_rows.withColumn("shard", shard(F.col("text_hash"), shards))
