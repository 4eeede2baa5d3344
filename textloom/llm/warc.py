"""WARC archives: writing with revisit records, and reading that verifies the chain of record boundaries.

Writing. One record per row. Of the rows with equal payloads the one with the largest key becomes the response and the
others revisits of it. Records leave through the text sink, whose line separator is the blank lines that end a record,
so any file system that Spark writes to will do and no Python touches the payloads.

Reading. The text source splits the files at the magic ``WARC/1.``, wherever it stands, also within payloads. Each task
turns its block's pieces into candidates (a piece that parses as a header) with the offset of the successor that the
header's length names, and condenses them: where does a candidate's chain leave the block? Pointer jumping over the
chains' exits, from offset 0 of each file, finds the offset at which the true chain enters each block, in rounds that
grow with the logarithm of a file's blocks. A second scan walks the true chain only; magic elsewhere is payload. A record that crosses a block's end comes out as
fragments, which are put together by record.

Defined cases: a null payload is empty; a null key is written and read back as null; rows with equal payload and the
group's largest key are responses each; an empty table writes no record and reads back as no rows. Bytes before the
first record aren't allowed (a file that doesn't start with a record gives none), a file whose chain breaks gives the
records up to the break, and a record that the file's end cuts off isn't given.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import SMALL_BYTES, arrow_map, bytes_of, ship, small, tidy
from textloom.session import materialise

MAGIC = "WARC/1."
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
URN, NULL_URN = "urn:record:", "urn:record-null:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four runs of ten hex digits are eight base32 digits each."""
    h = F.sha1(payload)
    runs = [F.lpad(F.conv(F.substring(h, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*runs), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<"), F.when(key.isNull(), F.lit(NULL_URN)).otherwise(F.concat(F.lit(URN), F.url_encode(key.cast("string")))), F.lit(">"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC file per task to the folder ``path``; equal payloads are stored once and revisited."""
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    rows = rows.withColumn("d", base32_sha1(F.col("p").cast("binary")))
    groups = rows.groupBy("d").agg(F.max("k").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("d").alias("gd"), "top")
    groups = materialise(groups, "revisited")
    # Few repeated digests go to the tasks, in a few passes if need be, so payloads aren't shuffled; many are joined by key.
    passes = -(-bytes_of(groups) // SMALL_BYTES) or 1
    if passes > 4:
        _write(rows.join(groups.hint("merge"), F.col("d") == F.col("gd"), "left"), path, date)
        return
    for k in range(passes):
        part = lambda c, k=k: F.pmod(F.xxhash64(c), F.lit(passes)) == k
        _write(rows.where(part("d")).join(F.broadcast(groups.where(part("gd"))), F.col("d") == F.col("gd"), "left"), path, date)


def _write(rows: DataFrame, path: str, date: str) -> None:
    """Records of rows (k, u, p, d, and top: the key of the response if the payload repeats)."""
    revisit = F.col("top").isNotNull() & ~F.col("k").eqNullSafe(F.col("top"))
    size = F.octet_length("p")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("k"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("u").isNotNull(), line("WARC-Target-URI", F.regexp_replace("u", r"[\r\n]", ""))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("d"))),
        line("X-Payload-Length", size.cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(F.col("top"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        F.when(revisit, F.lit(len(HTTP))).otherwise(size + len(HTTP)).cast("string"),
        F.lit(END + HTTP),
        F.when(revisit, F.lit("")).otherwise(F.col("p")),
    )
    rows.select(head.alias("value")).write.mode("append").option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, by file and block, in order within each task."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))


def _condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: its bytes, and of each candidate the place, where its chain leaves the block and the chain's last
    candidate in it."""

    def flush() -> pa.RecordBatch:
        size, reach = np.concatenate(sizes), np.concatenate(reaches)
        rel = np.cumsum(size + len(MAGIC)) - size - len(MAGIC)
        cand = reach >= 0
        if now[1] == 0:
            cand[0] = False  # no magic stands before a file's first piece
        at = rel[cand] - len(MAGIC)
        to = rel[cand] + reach[cand]
        n = len(at)
        up = np.searchsorted(at, to)
        inner = (up < n) & (at[np.minimum(up, n - 1)] == to) if n else np.zeros(0, bool)
        parent = np.where(inner, up, -1).tolist()
        leave, last = to.copy(), at.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                leave[i], last[i] = leave[parent[i]], last[parent[i]]
        total = int((size + len(MAGIC)).sum())
        whole = lambda x, extra: pa.array(np.append(np.asarray(x, np.int64), extra), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]] * (n + 1), pa.string()), whole([now[1]] * n, now[1]), whole(at, -1 << 40), whole(leave, total), whole(last, 0), pa.array(np.append(np.ones(n, bool), False))],
            names=["file", "block", "at", "leave", "last", "candidate"],
        )

    now, sizes, reaches = None, [], []
    for batch in batches:
        for part, key in _runs(batch):
            if key != now:
                if sizes:
                    yield flush()
                now, sizes, reaches = key, [], []
            sizes.append(part.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            reaches.append(part.column(3).to_numpy(zero_copy_only=False).astype(np.int64))
    if sizes:
        yield flush()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple[str, int]]]:
    """Runs of rows of one file and block (columns 0 and 1)."""
    if not batch.num_rows:
        return
    code = batch.column(0).dictionary_encode().indices.to_numpy()
    block = batch.column(1).to_numpy()
    cut = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(a, b - a), (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())


def reachable(spark: SparkSession, path: str) -> DataFrame:
    """Per block: file, block, base (offset of its first piece), enter (offset at which the true chain enters it, or
    null) and owner (offset of the record that its first pieces belong to, if they don't begin one)."""
    from pyspark.sql import Window

    raw = _pieces(spark, path)
    # The head ends at the first blank line; only pieces that begin like a header are searched for it.
    head = F.when(F.substring("value", 1, 3).isin("0\r\n", "1\r\n"), F.substring_index("value", END, 1))
    length = F.regexp_extract(head, r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,15})[ \t]*(?:\r\n|$)", 1)
    sized = raw.select("file", "block", F.octet_length("value").cast("long").alias("size"), F.coalesce(F.when(length != "", F.octet_length(head) + 8 + length.cast("long")), F.lit(-1)).cast("long").alias("reach"))
    ship(spark)
    found = materialise(sized.mapInArrow(tidy(_condense), "file string, block long, at long, leave long, last long, candidate boolean"), "warc")
    order = Window.partitionBy("file").orderBy("block")
    blocks = found.where("not candidate").select("file", "block", F.coalesce(F.sum("leave").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # Blocks are numbered; records go by their offset within the file of their block, whose number is its first block's.
    blocks = materialise(blocks.withColumn("no", F.monotonically_increasing_id()), "warc-blocks")
    blocks = materialise(blocks.withColumn("f", F.min("no").over(Window.partitionBy("file"))), "warc-blocks")
    # A block's first piece stands at base; in a file's first block it stands at 0 with no magic before it.
    cand = found.where("candidate").join(small(blocks), ["file", "block"])
    cand = materialise(cand.select("f", "no", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("leave")).alias("leave"), (F.col("base") + F.col("last")).alias("last")), "warc")
    # Of the candidates only those at which a chain enters a block matter from here on: one or a few a block, unless
    # payloads hold many magics.
    doors = cand.select("f", F.col("leave").alias("at")).union(blocks.where("block = 0").select("f", F.lit(0).cast("long"))).distinct()
    nodes = materialise(cand.join(doors.hint("merge"), ["f", "at"]), "warc")
    jumps = small(nodes.select("f", F.col("at").alias("leave")))
    seen = nodes.where("at = 0").select("f", "at")
    hop = nodes.join(jumps, ["f", "leave"]).select("f", "at", "leave")
    while True:  # pointer jumping: each round doubles the length of all jumps
        hop = materialise(hop, "warc")
        if hop.isEmpty():
            break
        step = seen.join(small(hop), ["f", "at"]).select("f", F.col("leave").alias("at"))
        seen = materialise(seen.union(step).distinct(), "warc")
        hop = hop.join(small(hop.select("f", F.col("at").alias("leave"), F.col("leave").alias("next"))), ["f", "leave"]).select("f", "at", F.col("next").alias("leave"))
    enter = materialise(nodes.join(small(materialise(seen, "warc")), ["f", "at"]).select("no", F.col("at").alias("enter"), "last"), "warc")
    out = blocks.join(small(enter), "no", "left")
    return materialise(out.select("file", "block", "base", "enter", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("owner")), "warc")


_FIELD = re.compile(rb"\r\n([^:\r\n]+):[ \t]*([^\r\n]*)")


def _walk(batches: Iterator[pa.RecordBatch], digests: bool) -> Iterator[pa.RecordBatch]:
    """The records of the true chain, from the pieces of each block in order."""
    out: list[tuple] = []
    held = 0
    now, pos, expect, owner, parts, size = None, 0, None, None, [], 0

    def close(last: bool) -> None:
        """What has been gathered for the owner: a whole record or, at a block's end, a fragment of one."""
        nonlocal parts, size, held
        if parts and owner is not None:
            data = b"".join(parts)
            need = _need(data) if begun == owner else -1
            if begun == owner and need <= len(data):
                out.append((now[0], owner, None, *record(data[:need], digests)))
            else:
                out.append((now[0], owner, begun, None, None, None, None, None, None, None, data))
            held += len(data)
        parts, size = [], 0

    begun = 0
    for batch in batches:
        for part, key in _runs(batch):
            if key != now:
                close(True)
                base, enter, own = (part.column(c)[0].as_py() for c in (3, 4, 5))
                now, pos, expect, owner = key, base, enter, own
                begun = base
            for piece in part.column(2):
                value = piece.as_buffer()
                start = pos - len(MAGIC)
                if expect is not None and start == expect and (now[1] or pos):
                    close(False)
                    owner = begun = start
                    data = MAGIC.encode() + value.to_pybytes()
                    expect = start + _need(data) + len(END)
                    parts = [data]
                elif owner is not None:
                    if not parts:
                        begun = start
                    parts.append(MAGIC.encode() + value.to_pybytes())
                pos += len(value) + len(MAGIC)
            if held > 4_000_000 or len(out) > 5_000:
                yield _batch(out)
                out, held = [], 0
    close(True)
    if out:
        yield _batch(out)


def _need(data: bytes) -> int:
    """Bytes of the record that begins here, without the blank lines that end it."""
    end = data.index(b"\r\n\r\n")
    return end + 4 + int(re.search(rb"(?i)\r\nContent-Length:[ \t]*([0-9]+)", data[: end + 2])[1])


def _key(urn: bytes | None) -> str | None:
    from urllib.parse import unquote_plus

    text = (urn or b"").decode("utf-8", "replace").strip("<>")
    return unquote_plus(text[len(URN) :]) if text.startswith(URN) else None


def record(data: bytes, digests: bool) -> tuple:
    """(type, key, refers to, uri, stated digest, payload bytes, digest, payload) of one whole record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, v in _FIELD.findall(head)}
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    kind = text(b"warc-type")
    stated = (text(b"warc-payload-digest") or "").removeprefix("sha1:") or None
    payload = block.partition(b"\r\n\r\n")[2] if fields.get(b"content-type", b"").startswith(b"application/http") else block
    if kind == "revisit":
        n = int(fields[b"x-payload-length"]) if b"x-payload-length" in fields else None
        return kind, _key(fields.get(b"warc-record-id")), _key(fields.get(b"warc-refers-to")), text(b"warc-target-uri"), stated, n, None, None
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return kind, _key(fields.get(b"warc-record-id")), None, text(b"warc-target-uri"), stated, len(payload), own, None if digests else payload


_SCHEMA = "file string, offset long, part long, record_type string, key string, refers_to string, target_uri string, stated_digest string, payload_bytes long, digest string, payload binary"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=names)


def _join_parts(batch: pa.RecordBatch, digests: bool) -> Iterator[pa.RecordBatch]:
    out = []
    for file, offset, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        data = b"".join(p["payload"] for p in sorted(parts, key=lambda p: p["part"]))
        if data.startswith(MAGIC.encode()) and b"\r\n\r\n" in data and _need(data) <= len(data):
            out.append((file, offset, None, *record(data[: _need(data)], digests)))
    if out:
        yield _batch(out)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all files in ``path``: file, offset, record_type, key, refers_to, target_uri, stated_digest,
    payload_bytes, digest (of the payload read; null for revisits) and, if asked for, payload."""
    ship(spark)
    blocks = reachable(spark, path)
    # A block needs three numbers: blocks of bounded bytes go to the tasks at a time, file by file beyond that.
    groups = -(-bytes_of(blocks) // SMALL_BYTES) or 1
    walked = None
    for g in range(groups):
        own = F.pmod(F.xxhash64("file"), F.lit(groups)) == g
        pieces = _pieces(spark, path).withColumn("value", F.col("value").cast("binary"))
        rows = pieces.where(own).join(F.broadcast(blocks.where(own).withColumnRenamed("base", "first")), ["file", "block"], "left")
        part = rows.select("file", "block", "value", F.col("first").alias("base"), "enter", "owner").mapInArrow(tidy(partial(_walk, digests=not payloads)), _SCHEMA)
        walked = part if walked is None else walked.unionByName(part)
    whole = walked.where("part is null").drop("part")
    if not blocks.where("block > 0 and owner is not null and (enter is null or enter > base - 7)").isEmpty():
        parts = walked.where("part is not null").groupBy("file", "offset").agg(F.collect_list(F.struct("part", "payload")).alias("parts"))
        whole = whole.unionByName(arrow_map(parts, partial(_join_parts, digests=not payloads), _SCHEMA).drop("part"))
    return whole if payloads else whole.drop("payload")


def digests(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` to ``path``, read the archives back: key, payload_bytes, payload_digest, record_type, refers_to."""
    write_archives(pages, path, key, url, payload)
    kind = pages.schema[key].dataType
    got = read_archives(pages.sparkSession, path, payloads=False)
    bad = F.raise_error(F.concat(F.lit("payload digest differs at "), F.col("file"), F.lit(":"), F.col("offset")))
    own = F.when(F.col("digest").isNull() | F.col("digest").eqNullSafe(F.col("stated_digest")), F.col("stated_digest")).otherwise(bad)
    return got.select(F.col("key").cast(kind).alias(key), "payload_bytes", own.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
