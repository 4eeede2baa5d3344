"""Command-line entries: ``python -m textloom.cli manifest|pilot|join|tokens|audit ...``.

Each reads its inputs with the readers, runs one operator and writes its results with a report; on a cluster, start it by
spark-submit, whose session is taken.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.operators import audit, ingest, manifest, pilot, splits, tokenizer_audit
from textloom.session import materialise
from textloom.sources import readers, writers


def at_least_one(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("1 at least")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *inputs: str) -> argparse.ArgumentParser:
        one = sub.add_parser(name)
        for i in inputs:
            one.add_argument(f"--{i}", required=True)
        one.add_argument("--output", required=True)
        return one

    one = add("manifest", "source")
    one.add_argument("--seed", type=int, default=42)
    one.add_argument("--shards", type=at_least_one, default=32)
    one.add_argument("--max-rows", type=at_least_one)
    one = add("pilot", "assignments")
    one.add_argument("--target-rows", type=at_least_one, default=10_000)
    one.add_argument("--human-fraction", type=float, default=0.5)
    one.add_argument("--seed", type=int, default=42)
    add("join", "source", "pilot")
    one = add("tokens", "rows", "vocabulary")
    one.add_argument("--max-length", type=at_least_one, default=512)
    one.add_argument("--examples", type=at_least_one, default=3)
    one = add("audit", "source")
    one.add_argument("--max-rows", type=at_least_one)
    return top


def run(spark: SparkSession, argv: list[str]) -> dict:
    """Run one command; returns what its report says."""
    a = parser().parse_args(argv)
    if a.command == "manifest":
        raw = readers.load_source(spark, "auto", a.source, a.max_rows)
        records = materialise(ingest.normalize(raw).drop("text", "title", "prompt"), "records")
        manifest.refuse_repeated_ids(records)
        rows = materialise(manifest.with_groups(materialise(manifest.kept(records), "kept")), "grouped")
        rows = materialise(rows.join(materialise(splits.assign_splits(manifest.group_stats(rows), a.seed), "splits"), "group_id"), "split-rows")
        writers.write_shards(rows, a.output, a.shards, {"seed": a.seed, "source": a.source})
        return {"removed": manifest.stats(raw, records).first().asDict(), "splits": writers.summary(rows)}
    if a.command == "pilot":
        train = materialise(readers.read_assignments(spark, a.assignments, "train"), "train")
        others = readers.read_assignments(spark, a.assignments, "validation").unionByName(readers.read_assignments(spark, a.assignments, "test"))
        chosen = materialise(pilot.select_groups(pilot.summarize(train), a.target_rows, a.human_fraction), "chosen")
        shared = {r["split"]: r["shared"] for r in pilot.overlap(chosen, others).collect()}
        if any(shared.values()):
            raise ValueError(f"selected groups occur in other splits: {shared}")
        rows = materialise(pilot.balanced(train.join(chosen, "group_id", "left_semi"), a.human_fraction, a.seed), "pilot")
        found = {**pilot.summary(train, chosen, rows), "overlap": shared}
        writers.write_pilot(rows, a.output, found)
        return found
    if a.command == "join":
        return writers.write_joined(readers.load_source(spark, "auto", a.source), readers.read_pilot(spark, a.pilot), a.output)
    if a.command == "tokens":
        rows = readers.load_source(spark, "auto", a.rows).select("record_id", "text", "label")
        found = tokenizer_audit.report(rows, tokenizer_audit.file_tokenizer(a.vocabulary), a.vocabulary.rsplit("/", 1)[-1], a.max_length, a.examples, ends=False)
        writers.write_report(spark, a.output, found)
        return found
    raw = readers.load_source(spark, "auto", a.source, a.max_rows)
    fields = ("label", "model", "domain", "attack", "decoding")
    found = {
        "runtime": readers.runtime_report(spark),
        "data": audit.scalars(raw).first().asDict(),
        "observed_fields": [r["field"] for r in audit.observed_fields(raw).collect()],
        "missing": {r["field"]: r["missing"] for r in audit.missing_fields(raw, readers.RAW_FIELDS).orderBy("field").collect()},
        "counts": writers.report(audit.category_counts(audit.prepared(raw).drop("text").withColumn("label", F.col("label").cast("string")), fields)),
    }
    writers.write_report(spark, a.output, found)
    return found


def main(argv: list[str] | None = None) -> None:
    import sys

    spark = SparkSession.builder.appName("textloom").getOrCreate()
    print(writers.to_json(run(spark, sys.argv[1:] if argv is None else argv)))


if __name__ == "__main__":
    main()
