"""Group selection, sampling, and joining a sample back to its source."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.operators import pilot, pilot_join
from textloom.sources import readers, writers

FIELDS = "record_id string, group_id string, label string, split string, model string, domain string, attack string"
ROWS = [
    ("h1", "g1", "0", "train", "human", "news", "none"), ("a1", "g1", "1", "train", "mistral", "news", "none"),
    ("h2", "g2", "0", "train", "human", "books", "none"), ("a2", "g2", "1", "train", "gpt2", "books", "whitespace"),
    ("h3", "g3", "0", "train", "human", "reddit", "none"), ("a3", "g3", "1", "train", "mpt", "reddit", "synonym"),
]


def test_groups_and_selection(spark):
    found = pilot.summarize(spark.createDataFrame(ROWS, FIELDS))
    assert sorted((r["group_id"], r["rows"], r["human"], r["ai"]) for r in found.collect()) == [("g1", 2, 1, 1), ("g2", 2, 1, 1), ("g3", 2, 1, 1)]
    chosen = pilot.select_groups(found, target_rows=4)
    assert chosen.count() == 2
    with pytest.raises(ValueError):
        pilot.select_groups(found, target_rows=1)


def test_selection_follows_the_plain_rule(spark):
    rows = [(f"g{k:02d}", f"m{k % 5}", f"d{k % 3}", f"a{k % 4}", 1 + k % 3) for k in range(40)]
    table = [(f"{g}-{i}", g, "0" if i < n else "1", "train", m, d, a) for g, m, d, a, n in rows for i in range(n + 2)]
    got = {r["group_id"] for r in pilot.select_groups(pilot.summarize(spark.createDataFrame(table, FIELDS)), target_rows=60).collect()}
    goal, have, covered, left, want = 30, 0, set(), {r[0]: (r[4], {("m", r[1]), ("d", r[2]), ("a", r[3])}) for r in rows}, set()
    while have < goal:
        g = min(left, key=lambda g: (abs(have + left[g][0] - goal) / goal + 3 * max(0, have + left[g][0] - goal) / goal - 0.03 * len(left[g][1] - covered), g))
        h, c = left.pop(g)
        have, covered = have + h, covered | c
        want.add(g)
    assert got == want


def test_sample_covers_every_category_first(spark):
    rows = [(f"r{k:03d}", "g", "1", "train", f"m{k % 7 if k < 20 else 0}", "d", "none") for k in range(200)]
    got = pilot.sample_rows(spark.createDataFrame(rows, FIELDS), 8, 42)
    assert got.count() == 8 and got.select("model").distinct().count() == 7
    assert pilot.sample_rows(spark.createDataFrame(rows, FIELDS), 0, 42).count() == 0
    assert pilot.sample_rows(spark.createDataFrame(rows, FIELDS), 500, 42).count() == 200


def test_files_end_to_end(spark, tmp_path):
    head = FIELDS.replace(" string", "").replace(" ", "")
    for split, rows in (("train", ROWS), ("validation", [("v1", "g8", "0", "validation", "human", "news", "none")]), ("test", [("t1", "g9", "1", "test", "gpt2", "news", "none")])):
        with gzip.open(tmp_path / f"record_assignments_{split}_00.csv.gz", "wt") as f:
            f.write("\n".join([head, *[",".join(r) for r in rows]]) + "\n")
    folder = f"file://{tmp_path}"
    train = readers.read_assignments(spark, folder, "train")
    others = readers.read_assignments(spark, folder, "validation").unionByName(readers.read_assignments(spark, folder, "test"))
    chosen = pilot.select_groups(pilot.summarize(train), target_rows=4)
    assert {r["split"]: r["shared"] for r in pilot.overlap(chosen, others).collect()} == {"validation": 0, "test": 0}
    done = pilot.balanced(train.join(chosen, "group_id", "left_semi"))
    writers.write_pilot(done, f"{folder}/out")
    assert readers.read_pilot(spark, f"{folder}/out/pilot_assignments").count() == 4
    assert readers.read_ids(spark, f"{folder}/out/pilot_record_ids").count() == 4
    with pytest.raises(FileNotFoundError):
        readers.assignment_paths(spark, folder, "other")


RAW = "id string, generation string, model string, domain string, attack string, decoding string, repetition_penalty string"


def _join_inputs(spark, extra=()):
    raw = [("h1", "one text", "human", "news", "none", "greedy", "1.0"), ("a1", "two text", "gpt2", "news", "none", "greedy", "1.0"), ("zz", "other", "gpt2", "news", "none", None, None)]
    rows = [(i, "0" if m == "human" else "1", "g", "train", m, d, a, dec, rep, hashlib.sha256(t.encode()).hexdigest()) for i, t, m, d, a, dec, rep in raw[:2]] + list(extra)
    return spark.createDataFrame(raw, RAW), spark.createDataFrame(rows, "record_id string, label string, group_id string, split string, model string, domain string, attack string, decoding string, repetition_penalty string, text_hash string")


def test_join_back_without_mismatches(spark):
    raw, rows = _join_inputs(spark)
    got = pilot_join.validated(raw, rows)
    assert {r["record_id"]: (r["label"], r["text"]) for r in got.collect()} == {"h1": (0, "one text"), "a1": (1, "two text")}
    assert pilot_join.id_sets_differ(rows.select("record_id"), rows).count() == 0


def test_join_back_fails_on_missing_repeated_and_differing_rows(spark):
    raw, rows = _join_inputs(spark, [("lost", "0", "g", "train", "human", "news", "none", "", "", None)])
    with pytest.raises(ValueError, match="not found"):
        pilot_join.validated(raw, rows)
    raw, rows = _join_inputs(spark)
    with pytest.raises(ValueError, match="twice"):
        pilot_join.validated(raw.unionByName(raw), rows)
    with pytest.raises(ValueError, match="differ"):
        pilot_join.validated(raw.withColumn("domain", F.lit("books")), rows)


def test_selection_equals_its_recursive_sql(spark, target=12):
    """The greedy steps, with a target that ends them early."""
    import duckdb

    from textloom.plans import catalogue

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    sql = "WITH RECURSIVE " + catalogue._PICKED.replace("least(10000,", f"least({target},") + " SELECT group_id FROM pick WHERE k > 0"
    rows = catalogue._train(catalogue._split_rows(spark, sf))
    got = {r["group_id"] for r in pilot.select_groups(pilot.summarize(rows), target).collect()}
    assert got == {g for (g,) in db.sql(sql).fetchall()} and got
