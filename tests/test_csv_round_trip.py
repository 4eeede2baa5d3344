"""CSV that is written and read back keeps every character of a text."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from textloom.plans import catalogue
from textloom.sources import readers, writers

ENDS = (" ", "\t", "\n", "\r", "\r\n", "\0", "\x0b", "\x1f", '"', "\\", ",", '\\"', " ", "　", "﻿", "#")
TEXTS = [f"{a}one{b}two{c}" for e in ENDS for a, b, c in ((e, "", ""), ("", e, ""), ("", "", e), (e, e, e))] + ['\\\0"', '"\0"', '\0\\",\r\n']


def against_sql(spark, tmp_path, name):
    table = {"doc_id": list(range(len(TEXTS))), "text": TEXTS, "lang": ["en", " de", "fr "] * (len(TEXTS) // 3) + ["en"] * (len(TEXTS) % 3)}
    pq.write_table(pa.table(table), tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = db.sql(catalogue.ORACLE[name])
    got = catalogue.QUERIES[name](spark, f"file://{tmp_path}").select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall()) and want.fetchall()


def test_source_by_name_equals_its_sql_on_odd_texts(spark, tmp_path):
    against_sql(spark, tmp_path, "source_by_name")


def test_source_csv_equals_its_sql_on_odd_texts(spark, tmp_path):
    against_sql(spark, tmp_path, "source_csv")


def test_sample_keeps_ids_with_odd_ends(spark, tmp_path):
    rows = [(f'{e}a"{e}{k}{e}', "g", str(k % 2), "train", f"m{e}", "d", None, "r") for k, e in enumerate(ENDS)]
    df = spark.createDataFrame(rows, "record_id string, group_id string, label string, split string, model string, domain string, attack string, pilot_rank string")
    writers.write_pilot(df, f"file://{tmp_path}/p")
    got = readers.read_pilot(spark, f"file://{tmp_path}/p/pilot_assignments").select("record_id", "model")
    assert sorted(tuple(r) for r in got.collect()) == sorted((r[0], r[4]) for r in rows)


@pytest.mark.parametrize("end", [" ", '\\"', "\r\n"])
def test_shards_keep_ids_with_odd_ends(spark, tmp_path, end):
    splits = ("train", "validation", "test")
    rows = [{c: f"{c}-{k}" for c in readers.ASSIGNMENT_FIELDS} | {"record_id": f"{end}r{k}{end}", "label": str(k % 2), "split": splits[k // 2], "group_id": f"g{k // 2}", "source_id": None, "adv_source_id": None, "text_length": "3", "text_hash": f"{k:08x}{k:056x}"} for k in range(6)]
    schema = ", ".join(f"{c} string" for c in readers.ASSIGNMENT_FIELDS)
    df = spark.createDataFrame([tuple(r[c] for c in readers.ASSIGNMENT_FIELDS) for r in rows], schema)
    writers.write_shards(df, f"file://{tmp_path}/m", 2)
    got = [r["record_id"] for s in splits for r in readers.read_assignments(spark, f"file://{tmp_path}/m", s).collect()]
    assert sorted(got) == sorted(r["record_id"] for r in rows)
