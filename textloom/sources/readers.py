"""Reading raw rows, assignments, ids, JSON lines, pairs and vocabularies."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.functions.text import strip
from textloom.operators.ingest import require, require_rows
from textloom.session import ship_package

RAW_FIELDS = ("id", "source_id", "adv_source_id", "model", "decoding", "repetition_penalty", "attack", "domain", "title", "prompt", "generation")
ASSIGNMENT_FIELDS = ("record_id", "group_id", "label", "split", "source_id", "adv_source_id", "model", "domain", "attack", "decoding", "repetition_penalty", "text_length", "text_hash")
PREFERRED_CSV = ("train.csv", "raid_train_sample.csv", "raid.csv")


def read_csv(spark: SparkSession, path: str | list[str], required: set[str] = frozenset({"id", "model"}), max_rows: int | None = None) -> DataFrame:
    """CSV with a header, quoted fields over several lines, doubled quotes; every value is text. ``.gz`` is read as such."""
    # Without charToEscapeQuoteEscaping the parser takes NUL for that character and drops it before some others.
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("charToEscapeQuoteEscaping", '"').option("encoding", "UTF-8").csv(path)
    require(df, set(required))
    return df.limit(max_rows) if max_rows else df


def _files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def assignment_paths(spark: SparkSession, folder: str, split: str) -> list[str]:
    """The shards of one split, as files of the split's name or in the folders of ``write_shards``; others aren't opened."""
    found = _files(spark, folder, f"record_assignments_{split}_*") or _files(spark, folder, f"assignments/split={split}/shard=*/*.csv*")
    if not found:
        raise FileNotFoundError(f"no shards of {split} in {folder}")
    return found


def read_assignments(spark: SparkSession, folder: str, split: str) -> DataFrame:
    from textloom.operators.pilot import check_assignments

    rows = read_csv(spark, assignment_paths(spark, folder, split), required=set())
    if "split" not in rows.columns:  # the folder's name says it
        rows = rows.withColumn("split", F.lit(split)).select(*ASSIGNMENT_FIELDS)
    check_assignments(rows, split)
    return rows


def read_pilot(spark: SparkSession, path: str) -> DataFrame:
    """Assignments of a sample: ids that are there and unique, split train, labels 0 or 1, one row at least."""
    rows = read_csv(spark, path, required={"record_id", "label", "split"})
    require_rows(rows, (F.coalesce("record_id", F.lit("")) == "") | ~F.col("split").eqNullSafe("train") | ~F.coalesce(F.col("label").isin("0", "1"), F.lit(False)), "bad sample rows")
    again = rows.groupBy("record_id").count().where("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"ids repeat: {[r['record_id'] for r in again]}")
    if rows.isEmpty():
        raise ValueError("the sample is empty")
    return rows


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one a line; blanks around them and blank lines don't count."""
    return spark.read.text(path).select(strip(F.col("value")).alias("record_id")).where("record_id <> ''").distinct()


def is_gzip(spark: SparkSession, path: str) -> bool:
    """By the first two bytes, whatever the name. A folder is none: its files are read by their names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        return False
    stream = fs.open(p)
    try:
        return (stream.read(), stream.read()) == (0x1F, 0x8B)
    finally:
        stream.close()


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines, also gzip under another name; blank lines don't count, anything but an object fails."""
    if is_gzip(spark, path) and not path.endswith(".gz"):
        import gzip

        raw = spark.read.format("binaryFile").load(path).select("content")  # one file, one record: gzip can't be split
        ship_package(spark)

        def lines(batches):
            import pyarrow as pa

            for b in batches:
                for c in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(gzip.decompress(c).decode("utf-8").split("\n"), pa.string())], names=["value"])

        text = raw.mapInArrow(lines, "value string")
    else:
        text = spark.read.text(path)
    text = text.where(F.col("value").rlike(r"(?U)\S"))
    require_rows(text.select(F.substring("value", 1, 200).alias("value")), ~F.col("value").rlike(r"(?U)^\s*\{"), "lines that aren't objects")
    reader = spark.read.option("mode", "FAILFAST")
    found = schema or reader.json(text).schema
    return text.select(F.from_json("value", found, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    fields = StructType([StructField(c, StringType()) for c in ("page_title", "human_text", "ai_text")])
    return read_jsonl(spark, path, fields)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, weight) of a flat JSON object; a file that isn't there is an empty vocabulary."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "word string, weight double")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,double>"))).toDF("word", "weight")


def find_one(spark: SparkSession, folder: str, *names: str) -> str:
    """The one file of these names in the folder and below."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    found = [r["path"] for r in files.where(F.element_at(F.split("path", "/"), -1).isin(*names)).limit(2).collect()]
    if len(found) != 1:
        raise FileNotFoundError(f"exactly one of {names} is expected in {folder}, found {len(found)}")
    return found[0]


def find_csv(spark: SparkSession, folder: str) -> str:
    """A preferred name if there is one, else the first CSV by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    first = files.withColumn("o", F.coalesce(F.array_position(F.array(*[F.lit(x) for x in PREFERRED_CSV]), name).cast("int"), F.lit(0))).orderBy(F.when(F.col("o") == 0, 99).otherwise(F.col("o")), "path").first()
    if first is None:
        raise FileNotFoundError(f"no CSV in {folder}")
    return first["path"]


def load_source(spark: SparkSession, mode: str, path: str, max_rows: int | None = None) -> DataFrame:
    """``csv``, ``json``, ``parquet``, or ``auto`` by the name's ending."""
    if mode == "auto":
        bare = path.removesuffix(".gz")
        mode = "json" if bare.endswith((".json", ".jsonl")) else "csv" if bare.endswith(".csv") else "parquet"
    if mode not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown source mode {mode}")
    df = read_csv(spark, path) if mode == "csv" else read_jsonl(spark, path) if mode == "json" else spark.read.parquet(path)
    return df.limit(max_rows) if max_rows else df


def positive(name: str, default: int) -> int:
    """A positive whole number from the environment."""
    raw = os.environ.get(name)
    value = default if raw in (None, "") else int(raw)
    if value < 1:
        raise ValueError(f"{name} must be 1 at least")
    return value


def source_from_environment(spark: SparkSession, prefix: str = "TEXTLOOM") -> DataFrame:
    """The source that {prefix}_SOURCE (path), {prefix}_MODE (auto) and {prefix}_MAX_ROWS (all) name."""
    path = os.environ.get(f"{prefix}_SOURCE")
    if not path:
        raise ValueError(f"{prefix}_SOURCE names no source")
    most = os.environ.get(f"{prefix}_MAX_ROWS")
    return load_source(spark, os.environ.get(f"{prefix}_MODE", "auto"), path, positive(f"{prefix}_MAX_ROWS", 1) if most else None)


def runtime_report(spark: SparkSession) -> dict:
    """Versions and settings that a report of a run should name."""
    import platform

    conf = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")
    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "java": spark._jvm.System.getProperty("java.version"), "parallelism": spark.sparkContext.defaultParallelism, "settings": {c: spark.conf.get(c, None) for c in conf}}


def to_json(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)

