"""Writing manifests, samples, reports and vocabularies. Checks run before a write begins; the committer publishes whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.stable import shard
from textloom.operators import manifest, pilot_join
from textloom.session import materialise
from textloom.sources.readers import ASSIGNMENT_FIELDS, to_json


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, made whole under another name and then renamed."""
    p, tmp = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, path + ".part"))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(tmp, p)


def write_report(spark: SparkSession, path: str, report) -> None:
    write_text(spark, path, to_json(report) + "\n")


def report(counts: DataFrame) -> dict:
    """Nested counters from a small long form (section, key, rows), keys sorted."""
    out: dict = {}
    for r in counts.orderBy("section", "key").toLocalIterator():
        out.setdefault(r["section"], {})[r["key"]] = r["rows"]
    return out


def summary(split_rows: DataFrame) -> dict:
    """Rows, groups, labels, models, domains and attacks of each split, for a report."""
    out: dict = {}
    for r in manifest.distribution(split_rows).orderBy("split", "section", "key").toLocalIterator():
        per = out.setdefault(r["split"], {})
        if r["key"] == "" and r["section"] in ("rows", "groups"):
            per[r["section"]] = r["rows"]
        elif r["rows"]:
            per.setdefault(r["section"], {})[r["key"]] = r["rows"]
    return out


#: Quotes are doubled; Spark's writer cuts blanks, line ends and control characters off both ends of a value unless told not to.
CSV = {"header": True, "escape": '"', "charToEscapeQuoteEscaping": '"', "compression": "gzip", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, path: str) -> None:
    """Gzip CSV with a header that ``readers.read_csv`` reads back: every character is kept; null and empty are one."""
    rows.write.options(**CSV, emptyValue="").mode("overwrite").csv(path)


def write_splits(rows: DataFrame, path: str, order: str | None = None) -> dict:
    """JSON lines by split, after the manifest's checks, and _manifest_summary.json beside them (Spark's readers skip names
    like this); in order of ``order`` if given, across the files of a split as well."""
    manifest.validate(rows)
    (rows.orderBy("split", order) if order else rows).write.partitionBy("split").mode("overwrite").json(path)
    found = summary(rows)
    write_report(rows.sparkSession, f"{path}/_manifest_summary.json", found)
    return found


def write_shards(rows: DataFrame, path: str, shards: int = 32, config: dict | None = None) -> DataFrame:
    """Assignments as gzip CSV by split and shard, sorted by id within, with shard_index.json, manifest_summary.json and
    config.json beside them; returns (split, shard, rows)."""
    if shards < 1:
        raise ValueError("one shard is needed at least")
    manifest.validate(rows)
    spark = rows.sparkSession
    out = rows.select(*[F.col(c) for c in ASSIGNMENT_FIELDS]).withColumn("shard", shard(F.col("text_hash"), shards))
    by = out.repartition(F.col("split"), F.col("shard")).sortWithinPartitions("split", "shard", "record_id")
    by.write.partitionBy("split", "shard").options(**CSV).mode("overwrite").csv(f"{path}/assignments")
    counts = shard_counts(out)
    index = [r.asDict() for r in counts.orderBy("split", "shard").collect()]  # splits times shards
    write_report(spark, f"{path}/shard_index.json", {"shards": shards, "fields": list(ASSIGNMENT_FIELDS), "files": index})
    write_report(spark, f"{path}/manifest_summary.json", summary(rows))
    write_report(spark, f"{path}/config.json", {"shards": shards, **(config or {})})
    return counts


def shard_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "shard").agg(F.count(F.lit(1)).alias("rows"))


def write_pilot(rows: DataFrame, path: str, found: dict | None = None) -> None:
    """A sample's assignments, its ids, in the sample's order, and pilot_summary.json; a sample is small, so one file each."""
    ordered = rows.orderBy("pilot_rank")
    ordered.coalesce(1).drop("pilot_rank").write.options(**CSV).mode("overwrite").csv(f"{path}/pilot_assignments")
    ordered.select("record_id").coalesce(1).write.mode("overwrite").text(f"{path}/pilot_record_ids")
    labels = {r["label"]: r["n"] for r in rows.groupBy(F.col("label").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()}
    write_report(rows.sparkSession, f"{path}/pilot_summary.json", {"rows": sum(labels.values()), "labels": labels, **(found or {})})


def write_joined(raw: DataFrame, assignments: DataFrame, path: str) -> dict:
    """The sample with its texts as gzip JSON lines in order of id, and join_summary.json; nothing is written unless all
    checks pass."""
    done = materialise(pilot_join.validated(raw, assignments), "joined")
    found = pilot_join.summary(done, assignments)
    done.orderBy("record_id").write.option("compression", "gzip").mode("overwrite").json(f"{path}/pilot_texts")
    write_report(raw.sparkSession, f"{path}/join_summary.json", found)
    return found


def write_vocabulary(words: DataFrame, path: str) -> None:
    """A flat JSON object in the vocabulary's order."""
    found = words.orderBy(F.col("weight").desc(), "word").collect()
    write_report(words.sparkSession, path, {r["word"]: r["weight"] for r in found})
