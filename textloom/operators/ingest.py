"""Row-level derivations of raw records: labels, normalised records, pairs, and checks that fail before any write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.stable import sha256
from textloom.functions.text import is_blank, strip


def column(df: DataFrame, name: str) -> Column:
    """The column as text, or null if there is none of that name."""
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def label_of_model(model: Column) -> Column:
    """0 for ``human`` (any case, blanks around it), else 1."""
    return F.when(F.lower(strip(model)) == "human", 0).otherwise(1).cast("int")


def audit_label(label: Column, model: Column) -> Column:
    """0, 1 or null: a label that says so, else by the model, else unknown."""
    said = F.lower(strip(F.coalesce(label, F.lit(""))))
    own = strip(F.coalesce(model, F.lit("")))
    return F.when(said.isin("0", "human", "false"), 0).when(said.isin("1", "ai", "generated", "true"), 1).when(own == "", None).otherwise(label_of_model(own)).cast("int")


def loader_label(label: Column, is_ai: Column) -> Column:
    """1 if the first non-empty of the two holds ``1`` or ``ai`` (any case), else 0."""
    raw = F.coalesce(none_if_empty(label), none_if_empty(is_ai), F.lit("0"))
    return F.when(raw.contains("1") | F.lower(raw).contains("ai"), 1).otherwise(0).cast("int")


def raw_text(df: DataFrame) -> Column:
    """``generation`` unless it is null, else ``text``, else empty."""
    return F.coalesce(column(df, "generation"), column(df, "text"), F.lit(""))


def first_text(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is neither null nor empty, else empty."""
    return F.coalesce(*[none_if_empty(column(df, n)) for n in names], F.lit(""))


def require(df: DataFrame, columns: set[str]) -> None:
    missing = sorted(columns - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def require_rows(df: DataFrame, bad: Column, what: str) -> None:
    """Fail with the first offending rows. An action, so that no pruning removes the check."""
    found = df.where(bad).limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def check_raw(df: DataFrame) -> None:
    """Every record needs an id and a model, blank text or not."""
    require(df, {"id", "model"})
    require_rows(df.select("id", "model"), (F.coalesce(F.col("id"), F.lit("")) == "") | (F.coalesce(F.col("model"), F.lit("")) == ""), "records without id or model")


def normalize(df: DataFrame) -> DataFrame:
    """Raw rows to records; blank texts go."""
    text = raw_text(df)
    out = df.select(
        F.col("id").cast("string").alias("record_id"),
        text.alias("text"),
        label_of_model(F.col("model")).alias("label"),
        *[none_if_empty(column(df, c)).alias(c) for c in ("source_id", "adv_source_id")],
        F.col("model"),
        *[none_if_empty(column(df, c)).alias(c) for c in ("decoding", "repetition_penalty")],
        F.coalesce(none_if_empty(column(df, "attack")), F.lit("none")).alias("attack"),
        F.coalesce(none_if_empty(column(df, "domain")), F.lit("unknown")).alias("domain"),
        F.coalesce(column(df, "title"), F.lit("")).alias("title"),
        none_if_empty(column(df, "prompt")).alias("prompt"),
        F.length(text).alias("text_length"),
        sha256(text).alias("text_hash"),
    )
    return out.where(~is_blank(F.col("text")))


def parse(df: DataFrame) -> DataFrame:
    """Raw rows to samples: text, model, domain, attack, decoding, title, is_ai; blank texts go."""
    or_else = lambda name, value: F.coalesce(none_if_empty(column(df, name)), F.lit(value))
    text = first_text(df, "generation", "text")
    model = or_else("model", "unknown")
    out = df.select(
        *([F.col("id").cast("string").alias("id")] if "id" in df.columns else []),
        strip(text).alias("text"),
        model.alias("model"),
        or_else("domain", "general").alias("domain"),
        or_else("attack", "none").alias("attack"),
        or_else("decoding", "default").alias("decoding"),
        F.coalesce(column(df, "title"), F.lit("")).alias("title"),
        F.when(F.lower(model) == "human", 0).otherwise(1).cast("int").alias("is_ai"),
    )
    return out.where(F.col("text") != "")


def pairs_to_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """A human and a rewritten text side by side become two labelled rows; null and empty texts give none."""
    side = lambda c, label, model: F.struct(F.col(c).alias("text"), F.lit(label).alias("label"), F.lit(model).alias("model"))
    both = F.filter(F.array(side("human_text", 0, "human"), side("ai_text", 1, "gpt_rewrite")), lambda x: x.text.isNotNull() & (x.text != ""))
    out = df.select(*keys, F.explode(both).alias("x"))
    return out.select(*keys, strip(F.col("x.text")).alias("text"), F.col("x.label").alias("label"), F.col("x.model").alias("model"))


def human_samples(df: DataFrame) -> DataFrame:
    return df.where((F.col("model") == "human") | (F.col("label") == "0"))


def ai_samples(df: DataFrame) -> DataFrame:
    """Rows that some model or label marks as generated; an absent model counts."""
    return df.where(~F.col("model").eqNullSafe("human") | (F.col("label") == "1"))
