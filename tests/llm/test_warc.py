"""Archives: round trips, payloads that hold the magic, files cut anywhere into blocks."""

import base64
import hashlib
import uuid

import pytest

from textloom.llm import warc


def brute(rows):
    top = {}
    for k, _, p in rows:
        if k is not None:
            top[p or ""] = max(top.get(p or "", k), k)
    out = []
    for k, _, p in rows:
        b = (p or "").encode()
        lead = top.get(p or "")
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if lead is not None and k != lead else "response", lead if lead is not None and k != lead else None))
    return sorted(out, key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (1, "http://a/", "<p>ü 你好</p>"), (2, "http://b/\r\nX: y", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1."), (7, "u", FAKE * 3), (8, "u", "x" + FAKE + "y" * 3000),
    (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (10, "u", "z" * 20000), (11, "u", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n"), (12, "u", "same"), (None, "u", "lonely"), (None, "u", "same"), (13, "u", "WARC/1.1\r\nContent-Length: x\r\n\r\n"),
]


@pytest.mark.parametrize("block", ["64m", "1000b", "300b"])
def test_round_trip_with_magic_in_payloads(spark, tmp_path, block):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(2)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = [tuple(r) for r in warc.digests(pages, f"file://{tmp_path}/{uuid.uuid4().hex}").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == brute(ROWS)


def test_payloads_come_back_whole(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1), path)
    got = {r["key"]: bytes(r["payload"]) for r in warc.read_archives(spark, path).collect() if r["record_type"] == "response"}
    assert got["8"].decode() == ROWS[7][2] and got["1"].decode() == ROWS[0][2] and got["11"].decode() == ROWS[10][2]


def test_broken_and_cut_files_give_the_records_up_to_the_break(spark, tmp_path):
    one = lambda k, p: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:{k}>\r\nContent-Length: {len(p)}\r\n\r\n{p}\r\n\r\n"
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.warc").write_bytes((one(1, "a") + one(2, "bb") + "junk" + one(3, "c")).encode())
    (folder / "b.warc").write_bytes(("junk" + one(4, "d")).encode())
    (folder / "c.warc").write_bytes(one(5, "e").encode() + one(6, "f" * 100).encode()[:-60])
    assert {r["key"] for r in warc.read_archives(spark, f"file://{folder}").collect()} == {"1", "2", "5"}


def test_no_rows(spark, tmp_path):
    assert warc.digests(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e").count() == 0


def test_clashing_columns_and_repeated_keys(spark, tmp_path):
    rows = [(1, "u", "a", "x", 0, "k"), (1, "u", "a", "x", 0, "k"), (1, "u", "b", "y", 1, "k"), (2, "u", "a", "z", 2, "k"), (3, None, "", None, 3, None), (4, "u", "long " * 200_000, "x", 4, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, d string, top int, file string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.digests(df, f"file://{tmp_path}/c").collect()), key=str)
    want = [(1, 1, "revisit", 2), (1, 1, "revisit", 2), (1, 1, "response", None), (2, 1, "response", None), (3, 0, "response", None), (4, 1_000_000, "response", None)]
    assert got == sorted(want, key=str)
