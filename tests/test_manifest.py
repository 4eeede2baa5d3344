"""Dedup, quarantine, lineage and splits on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import ingest, manifest, splits
from textloom.operators.components import connected_components
from textloom.sources import writers

FIELDS = "id string, source_id string, adv_source_id string, model string, attack string, domain string, generation string"
ROWS = [
    ("human-1", "source-1", "source-1", "human", "none"),
    ("ai-1", "source-1", "source-1", "mistral", "none"),
    ("attack-1", "source-1", "adv-1", "mistral", "whitespace"),
    ("human-2", "source-2", "source-2", "human", "none"),
    ("ai-2", "source-3", "source-3", "gpt2", "none"),
    ("human-3", "source-4", "source-4", "human", "none"),
    ("ai-3", "source-5", "source-5", "llama-chat", "upper_lower"),
    ("human-4", "source-6", "source-6", "human", "none"),
]


def raw(spark, *more):
    rows = [(*r, "abstracts", f"text of {r[0]}") for r in ROWS] + list(more)
    return spark.createDataFrame(rows, FIELDS)


DUPLICATE = ("duplicate-later", "source-9", "source-9", "gpt2", "none", "abstracts", "text of ai-3")
CONFLICT = ("conflict-human", "source-9", "source-9", "human", "none", "abstracts", "text of ai-3")


def test_duplicates_keep_the_smallest_id_and_labels_follow_models(spark):
    df = raw(spark, DUPLICATE)
    records = ingest.normalize(df)
    got = {r["record_id"]: r["label"] for r in manifest.kept(records).collect()}
    assert "duplicate-later" not in got and len(got) == 8
    assert all(label == (0 if k.startswith("human") else 1) for k, label in got.items())
    assert manifest.stats(df, records).first().asDict() == {"rows_kept": 8, "duplicate_texts_removed": 1, "conflicting_texts_removed": 0, "conflicting_rows_removed": 0, "empty_rows_removed": 0}


def test_contradictory_labels_are_quarantined(spark):
    df = raw(spark, CONFLICT)
    records = ingest.normalize(df)
    assert not {"ai-3", "conflict-human"} & {r["record_id"] for r in manifest.kept(records).collect()}
    s = manifest.stats(df, records).first()
    assert (s["conflicting_texts_removed"], s["conflicting_rows_removed"]) == (1, 2)


def test_arrival_order_counts_a_duplicate_before_the_contradiction(spark):
    rows = [(k, k, None, m, "none", "d", "same") for k, m in (("a", "human"), ("b", "human"), ("c", "gpt2"))]
    df = spark.createDataFrame(rows, FIELDS)
    records = ingest.normalize(df).withColumn("position", F.ascii("record_id"))
    s = manifest.stats_in_arrival_order(df, records, "position").first()
    assert (s["duplicate_texts_removed"], s["conflicting_rows_removed"], s["rows_kept"]) == (1, 2, 0)


def test_lineage_joins_rows_that_share_a_link(spark):
    got = {r["record_id"]: r["group_id"] for r in manifest.with_groups(ingest.normalize(raw(spark))).collect()}
    assert got["human-1"] == got["ai-1"] == got["attack-1"]
    assert len(set(got.values())) == 6


def test_components_of_chains_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 201), (201, 200)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u int, v int"), "u", "v").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u int, v int"), "u", "v").count() == 0


@pytest.mark.parametrize("objective", ["cost", "delta"])
def test_splits_keep_groups_and_follow_the_plain_rule(spark, objective):
    rows = [(f"g{k:03d}", 1 + (k * 7) % 5, k % 2, 1 + (k * 7) % 5 - k % 2) for k in range(60)]
    got = {r["group_id"]: r["split"] for r in splits.assign_splits(spark.createDataFrame(rows, "group_id string, size long, human long, ai long"), seed=7, objective=objective).collect()}
    assert got == plain_splits(rows, 7, objective)


def plain_splits(rows, seed, objective):
    import hashlib

    total = [sum(r[k] for r in rows) for k in (1, 2, 3)]
    target = {s: [t * splits.RATIOS[s] for t in total] for s in splits.ORDER}
    state, out = {s: [0, 0, 0] for s in splits.ORDER}, {}

    def put(s, r):
        state[s] = [a + b for a, b in zip(state[s], r[1:])]
        out[r[0]] = s

    for s in splits.ORDER:
        put(s, min((r for r in rows if r[0] not in out), key=lambda r: (sum(abs(x - t) / max(t, 1) for x, t in zip(r[1:], target[s])), r[0])))

    def cost(s, r):
        off = [abs(a + b - t) / max(t, 1) for a, b, t in zip(state[s], r[1:], target[s])]
        return off[0] + 2 * (off[1] + off[2]) - 3 * sum(state[s][k] == 0 and r[1 + k] > 0 for k in (1, 2))

    for r in sorted((r for r in rows if r[0] not in out), key=lambda r: (-r[1], hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())):
        none = (r[0], 0, 0, 0)
        put(min(splits.ORDER, key=lambda s: (cost(s, r) - (cost(s, none) if objective == "delta" else 0), s)), r)
    return out


def test_split_parameters_are_checked(spark):
    two = spark.createDataFrame([("a", 1, 1, 0), ("b", 1, 0, 1)], "group_id string, size long, human long, ai long")
    with pytest.raises(ValueError, match="three groups"):
        splits.assign_splits(two)
    with pytest.raises(ValueError, match="sum to 1"):
        splits.check_ratios({"train": 0.5, "validation": 0.1, "test": 0.1})
    with pytest.raises(ValueError, match="must name"):
        splits.check_ratios({"train": 1.0})


def test_written_splits_agree_with_their_summary(spark, tmp_path):
    rows = [(f"r{k}", f"s{k}", f"a{k}", "human" if k % 2 else "gpt2", "none", "d", f"text {k}") for k in range(60)]
    grouped = manifest.with_groups(ingest.normalize(spark.createDataFrame(rows, FIELDS))).cache()
    done = grouped.join(splits.assign_splits(manifest.group_stats(grouped)), "group_id").cache()
    manifest.validate(done)
    writers.write_splits(done, f"file://{tmp_path}/splits")
    back = spark.read.json(f"file://{tmp_path}/splits")
    assert {r["split"]: r["count"] for r in back.groupBy("split").count().collect()} == {r["split"]: r["count"] for r in done.groupBy("split").count().collect()}
    counts = writers.write_shards(done, f"file://{tmp_path}/shards", 4)
    assert counts.agg(F.sum("rows")).first()[0] == 60
    writers.write_report(spark, f"file://{tmp_path}/report.json", writers.report(manifest.distribution(done).drop("split").groupBy("section", "key").agg(F.sum("rows").alias("rows"))))
    assert json.loads((tmp_path / "report.json").read_text())["rows"][""] == 60


def test_leaks_and_missing_classes_fail(spark):
    cols = "split string, label int, group_id string, source_id string, adv_source_id string, text_hash string"
    leak = spark.createDataFrame([("train", 0, "g", "s", None, "x"), ("test", 1, "g", "t", None, "y")], cols)
    with pytest.raises(ValueError, match="several splits"):
        manifest.validate(leak)
    one = spark.createDataFrame([("train", 0, "g", "s", None, "x")], cols)
    with pytest.raises(ValueError, match="both classes"):
        manifest.validate(one)
