"""Profiling of raw records in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.stable import sha256, stable_rank
from textloom.functions.text import preview, strip
from textloom.operators.ingest import audit_label, column, first_text


def prepared(df: DataFrame, *keep: Column) -> DataFrame:
    """What the audit looks at: id, label, model, domain, attack, decoding and the stripped text (and ``keep``)."""
    return df.select(
        *keep,
        column(df, "id").alias("id"),
        audit_label(column(df, "label"), column(df, "model")).alias("label"),
        *[F.coalesce(F.when(column(df, c) != "", column(df, c)), F.lit("missing")).alias(c) for c in ("model", "domain", "attack", "decoding")],
        column(df, "source_id").alias("source_id"),
        column(df, "adv_source_id").alias("adv_source_id"),
        strip(first_text(df, "generation", "text", "content")).alias("text"),
    )


def category_counts(df: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(section, key, rows) of all dimensions in one pass."""
    cells = F.array(*[F.struct(F.lit(d).alias("section"), F.col(d).cast("string").alias("key")) for d in dims])
    return df.select(F.explode(cells).alias("c")).groupBy("c.section", "c.key").agg(F.count(F.lit(1)).alias("rows"))


def missing_fields(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, missing) of the fields that are null or empty somewhere; an absent column is missing everywhere."""
    gaps = df.agg(*[F.count_if(F.coalesce(column(df, f), F.lit("")) == "").alias(f) for f in fields])
    return gaps.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields])).alias("x")).select("x.*").where("missing > 0")


def observed_fields(rows: DataFrame, json: str | None = None) -> DataFrame:
    """(field): the distinct keys that rows have; of the JSON objects in column ``json`` if one is named, else the columns."""
    if json is None:
        return rows.sparkSession.createDataFrame([(c,) for c in sorted(rows.columns)], "field string")
    return rows.select(F.explode(F.json_object_keys(F.col(json))).alias("field")).distinct()


def shuffled(rows: DataFrame, key: str, limit: int | None = None, seed: int = 42) -> DataFrame:
    """The rows, or the first ``limit``, in an order that looks random and that ``seed`` fixes: by stable hash of the key,
    over all rows and not within a buffer of them."""
    ordered = rows.orderBy(stable_rank(F.col(key).cast("string"), seed), key)
    return ordered.limit(limit) if limit else ordered


def first_per_label(rows: DataFrame, n: int, position: str, label: str = "label") -> DataFrame:
    """The first ``n`` rows of each of the labels 0 and 1; fails if one has fewer."""
    first = F.row_number().over(Window.partitionBy(label).orderBy(position))
    out = rows.where(F.col(label).isin(0, 1)).withColumn("__k", first).where(F.col("__k") <= n).drop("__k")
    found = {r[label]: r["n"] for r in out.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    short = {y: found.get(y, 0) for y in (0, 1) if found.get(y, 0) < n}
    if short:
        raise ValueError(f"{n} rows of each label are needed, found {short}")
    return out


def as_dicts(rows: DataFrame) -> DataFrame:
    """(json): each row as a JSON object of its columns, nulls included."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))


def flat(nested: Column) -> Column:
    """The list inside a list of one list, null for none; lists of several fail."""
    at = F.when(F.size(nested) > 1, F.raise_error(F.lit("a list of several lists")).cast("int")).otherwise(0)
    return F.when(F.size(nested) > 0, F.get(nested, at))


def _distinct(c: Column) -> Column:
    return F.count_distinct(F.when(c != "", c))


def scalars(df: DataFrame) -> DataFrame:
    """One row of totals, exact distinct counts, duplicates and text lengths."""
    p = prepared(df)
    n = F.length("text")
    ids = F.count_if(F.coalesce(F.col("id"), F.lit("")) != "")
    total = p.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == 0).alias("human_rows"),
        F.count_if(F.col("label") == 1).alias("ai_rows"),
        F.count_if(F.col("label").isNull()).alias("unknown_rows"),
        _distinct(F.col("id")).alias("unique_ids"),
        _distinct(F.col("source_id")).alias("unique_sources"),
        _distinct(F.col("adv_source_id")).alias("unique_adv_sources"),
        (ids - _distinct(F.col("id"))).alias("duplicate_ids"),
        (F.count(F.lit(1)) - F.count_distinct(sha256(F.col("text")))).alias("duplicate_texts"),
        F.count_if(F.col("text") == "").alias("empty_texts"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_length"),
        F.coalesce(F.round(F.avg(n), 2), F.lit(0.0)).alias("mean_length"),
    )
    return total


def samples(df: DataFrame, position: str, k: int = 10, width: int = 300) -> DataFrame:
    """The first ``k`` rows by position, with a preview of the text."""
    first = prepared(df, F.col(position).alias("position")).orderBy("position").limit(k)
    return first.select("position", "id", "label", "model", "domain", "attack", "decoding", preview(F.col("text"), width).alias("text_preview"))


def parser_summary(samples_: DataFrame) -> DataFrame:
    """(section, key, rows, percent) of labels and categories."""
    cells = [F.struct(F.lit("label").alias("section"), F.when(F.col("is_ai") == 0, "human").otherwise("ai").alias("key"))]
    cells += [F.struct(F.lit(d).alias("section"), F.col(d).alias("key")) for d in ("model", "domain", "attack", "decoding")]
    counts = samples_.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.section", "c.key").agg(F.count(F.lit(1)).alias("rows"))
    total = samples_.agg(F.count(F.lit(1)).alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("section", "key", "rows", F.round(F.col("rows") * 100 / F.greatest("total", F.lit(1)), 1).alias("percent"))
