"""Token lengths and truncation under any tokenizer, from one Arrow-batched call per batch of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import preview
from textloom.operators.ingest import require, require_rows
from textloom.session import materialise, ship_package

Tokenizer = Callable[[str], list[int]]
LENGTHS = ("count", "min", "max", "mean", "median", "p90", "p95", "p99")


def whitespace_tokenizer(text: str) -> list[int]:
    """Ids of words parted by white space, with one id before and one behind."""
    return [0, *range(10, 10 + len(re.findall(r"\S+", text))), 2]


def file_tokenizer(path: str) -> Tokenizer:
    """The ids of a vocabulary file by the tokenizers library, which the workers must have; an empty text has one id, 0. The
    file's JSON travels with the tasks, so executors need no file."""
    with open(path, encoding="utf-8") as f:
        return partial(_encode, f.read())


@lru_cache(maxsize=1)
def _library(text: str):
    import tokenizers

    return tokenizers.Tokenizer.from_str(text)


def _encode(vocabulary: str, text: str) -> list[int]:
    return _library(vocabulary).encode(text, add_special_tokens=False).ids or [0]


def report(rows: DataFrame, tokenizer: Tokenizer, model_name: str, max_length: int = 512, example_limit: int = 3, ends: bool = True) -> dict:
    """One report: lengths of all rows and by label, truncation, masks checked, categories and the first examples."""
    if example_limit < 1:
        raise ValueError("example_limit must be 1 at least")
    check_rows(rows, unique=True)
    if rows.isEmpty():
        raise ValueError("there are no rows")
    full = tokenized(rows, tokenizer, max_length, ends)
    wrong = full.where((F.size("attention_mask") != max_length) | (F.size("special_tokens_mask") != max_length)).count()
    if wrong:
        raise ValueError(f"{wrong} rows have masks of another length than {max_length}")
    lengths = materialise(full.drop("token_ids", "attention_mask", "special_tokens_mask"), "token-lengths")
    one = lambda df: df.first().asDict()
    by = {str(r["label"]): {k: v for k, v in r.asDict().items() if k != "label"} for r in length_summary(lengths, "label").orderBy("label").collect()}
    return {"model": model_name, "max_length": max_length, "lengths": one(length_summary(lengths)), "by_label": by, "truncation": one(truncation(lengths)), "examples": [r.asDict() for r in examples(lengths, "record_id", example_limit).collect()]}


def check_rows(rows: DataFrame, unique: bool = False) -> None:
    require(rows, {"record_id", "text", "label"})
    label = F.col("label").cast("string")
    require_rows(rows.select("record_id", "label"), (F.coalesce(F.col("record_id"), F.lit("")) == "") | ~F.coalesce(label.isin("0", "1"), F.lit(False)), "bad rows")
    if unique and not rows.groupBy("record_id").count().where("count > 1").isEmpty():
        raise ValueError("record ids repeat")


def tokenized(rows: DataFrame, tokenizer: Tokenizer = whitespace_tokenizer, max_length: int = 512, ends: bool = True) -> DataFrame:
    """``rows`` with token_ids (cut to ``max_length``, the last id kept), attention_mask and special_tokens_mask (padded),
    original_length, truncated. ``ends``: the first and last ids are special tokens."""
    if max_length < 2:
        raise ValueError("max_length must be 2 at least")
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [tokenizer(t or "") for t in b.column("text").to_pylist()]
            if not all(ids):
                raise ValueError("the tokenizer gave no ids")
            cut = [x if len(x) <= max_length else [*x[: max_length - 1], x[-1]] for x in ids]
            mask = [[1] * len(x) + [0] * (max_length - len(x)) for x in cut]
            special = [[1, *[0] * (len(x) - 2), 1] + [1] * (max_length - len(x)) if ends and len(x) > 1 else [0] * len(x) + [1] * (max_length - len(x)) for x in cut]
            cols = [*b.columns, pa.array(cut, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int32())), pa.array(special, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "token_ids", "attention_mask", "special_tokens_mask", "original_length"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(run, f"{fields}, token_ids array<int>, attention_mask array<int>, special_tokens_mask array<int>, original_length int")
    return out.withColumn("truncated", F.col("original_length") > max_length)


def length_summary(lengths: DataFrame, *by: str, length: str = "original_length") -> DataFrame:
    """count, min, max, mean and exact percentiles, for all rows or by groups."""
    n = F.col(length)
    p = F.percentile(n, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    aggs = [F.count(F.lit(1)).alias("count"), F.min(n).alias("min"), F.max(n).alias("max"), F.round(F.avg(n), 3).alias("mean"), p.alias("p")]
    out = (lengths.groupBy(*by) if by else lengths).agg(*aggs)
    return out.select(*by, "count", "min", "max", "mean", *[F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(("median", "p90", "p95", "p99"))])


def truncation(lengths: DataFrame, text: str = "text") -> DataFrame:
    """One row: rows, empty texts, truncated rows and their rate."""
    n = F.count(F.lit(1))
    return lengths.agg(n.alias("rows"), F.count_if(~F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S")).alias("empty"), F.count_if("truncated").alias("truncated"), F.round(F.count_if("truncated") / F.greatest(n, F.lit(1)), 6).alias("rate"))


def examples(lengths: DataFrame, position: str, limit: int = 3, width: int = 240) -> DataFrame:
    return lengths.orderBy(position).limit(limit).select("record_id", "label", "original_length", "truncated", preview(F.col("text"), width).alias("text_preview"))
