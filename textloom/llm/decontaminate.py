"""Benchmark decontamination by greedy string tiling.

The test items are a stated query set in blocks of bounded bytes. A single block, whose bytes are measured first, goes to
all tasks; more of them lie in a written table and meet the documents in cells (item block, part of the documents), of
which a task holds the items and streams the documents past them. A running Karp-Rabin hash over ``k`` words seeds the
matches. Seeds that follow one another on a diagonal join to the longest common runs; only a run's first and last seed are
kept, and seeds are made in portions, so repetitive texts take bounded memory. The longest run that nothing has marked yet is marked as a tile, parts of overlapped runs return to
the queue, until no run of ``k`` words is left. The share of an item's words under tiles is its coverage, whatever the
order of the passages in the document. A document with ``min_coverage`` of an item is contaminated.

Defined cases: null, empty and wordless texts match nothing; an item of fewer than ``k`` words is too short to tell and
matches nothing; equal items each give a row; rows of equal doc_id give a row each; an empty benchmark gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.llm._common import arrow_map, ship, slices, small, tidy
from textloom.llm.words import K, shingles_of, text_bytes, words_of
from textloom.session import materialise

BLOCK_BYTES = 4 << 20
PORTION = 1 << 20  # seeds that are looked at together


class Items:
    """A block of test items: their words and the places of each run of k words, by its hash."""

    def __init__(self, ids: list, texts: pa.Array, k: int):
        self.ids, self.k = ids, k
        w = words_of(*text_bytes(texts))
        self.words, self.ptr = w.hash, w.ptr
        gram, unit = shingles_of(w, k)
        long = np.diff(w.ptr)[unit] >= k
        gram, unit = gram[long], unit[long]
        first = np.searchsorted(unit, np.arange(len(ids) + 1))
        place = np.arange(len(unit)) - first[unit]
        self.gram, number = np.unique(gram, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.at = np.append(np.searchsorted(number[order], np.arange(len(self.gram))), len(order))
        self.item, self.place = unit[order], place[order]
        self.number, self.first = number, first  # the grams of item j in order: number[first[j]:first[j + 1]]
        self.sample = self.ptr[self.item[self.at[:-1]]] + self.place[self.at[:-1]]  # where each gram's words stand
        self.may = np.zeros(1 << 20, bool)
        self.may[(self.gram >> np.uint64(44)).astype(np.int64)] = True


def runs_of(doc: np.ndarray, item: np.ndarray, k: int, portion: int = PORTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document place, item place, words) of the longest common runs, from the grams of k words at all places of both
    (-1 in ``doc``: none of the item's block)."""
    order = np.argsort(item, kind="stable")
    sorted_ = item[order]
    low, high = np.searchsorted(sorted_, doc, "left"), np.searchsorted(sorted_, doc, "right")
    count = np.where(doc >= 0, high - low, 0)
    live = np.flatnonzero(count)
    done = np.concatenate([[0], np.cumsum(count[live])])
    starts, ends, at = [], [], 0
    while at < len(live):
        to = max(at + 1, int(np.searchsorted(done, done[at] + portion, "right")) - 1)
        n = count[live[at:to]]
        d = np.repeat(live[at:to], n)
        i = order[np.arange(int(done[to] - done[at])) + np.repeat(low[live[at:to]] - (done[at:to] - done[at]), n)]
        at = to
        key = (d - i + len(item)) << 32 | d
        before = (d > 0) & (i > 0)
        before[before] = doc[d[before] - 1] == item[i[before] - 1]
        after = (d < len(doc) - 1) & (i < len(item) - 1)
        after[after] = doc[d[after] + 1] == item[i[after] + 1]
        starts.append(key[~before])
        ends.append(key[~after])
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    start, end = np.sort(np.concatenate(starts)), np.sort(np.concatenate(ends))
    d = start & 0xFFFFFFFF
    return d, d - ((start >> 32) - len(item)), (end & 0xFFFFFFFF) - d + k


def tile(doc: np.ndarray, item: np.ndarray, k: int, portion: int = PORTION) -> tuple[int, int]:
    """(marked words of the item, tiles), from the grams at all places of the document and the item."""
    d, i, n = runs_of(doc, item, k, portion)
    order = np.lexsort((i, d, -n))
    d, i, n = d[order], i[order], n[order]
    item_mark, doc_mark, tiles = np.zeros(len(item) + k - 1, bool), np.zeros(len(doc) + k - 1, bool), 0
    parts: list[tuple[int, int, int]] = []  # what is left of overlapped runs
    at = 0

    def room() -> bool:
        """Is a run of k words of the item still free?"""
        edge = np.flatnonzero(np.diff(np.concatenate([[1], item_mark.astype(np.int8), [1]])))
        return len(edge) > 0 and int((edge[1::2] - edge[::2]).max()) >= k

    while at < len(n) or parts:
        if at < len(n) and (not parts or (-int(n[at]), int(d[at]), int(i[at])) <= parts[0]):
            run = -int(n[at]), int(d[at]), int(i[at])
            at += 1
        else:
            run = heapq.heappop(parts)
        m, a, b = -run[0], run[1], run[2]
        taken = item_mark[b : b + m] | doc_mark[a : a + m]
        if not taken.any():
            item_mark[b : b + m] = True
            doc_mark[a : a + m] = True
            tiles += 1
            if not room():
                break
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(np.int8), [1]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if y - x >= k:
                heapq.heappush(parts, (x - y, a + x, b + x))
    return int(item_mark.sum()), tiles


def _hits(column: pa.Array, items: Items, min_coverage: float) -> list[tuple[int, object, float, int, int]]:
    """(row, item id, coverage, tiles, item words) of the rows that hold enough of an item."""
    k = items.k
    w = words_of(*text_bytes(column))
    if not len(items.gram) or len(w.hash) < k:
        return []
    gram, unit = shingles_of(w, k)
    near = np.flatnonzero(items.may[(gram >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(items.gram, gram[near])
    at[at == len(items.gram)] = 0
    ok = (items.gram[at] == gram[near]) & (np.diff(w.ptr)[unit[near]] >= k)
    near, at = near[ok], at[ok]
    first = np.searchsorted(unit, np.arange(len(column)))
    place = near - first[unit[near]]
    word = w.ptr[unit[near]] + place
    same = np.ones(len(near), bool)
    for x in range(k):  # equal hashes of runs are checked word by word
        same &= w.hash[word + x] == items.words[items.sample[at] + x]
    near, at, place = near[same], at[same], place[same]
    out = []
    edges = np.flatnonzero(np.diff(np.concatenate([[-1], unit[near], [-1]])))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        row = int(unit[near[a]])
        grams = np.unique(at[a:b])
        count = items.at[grams + 1] - items.at[grams]
        flat = np.repeat(items.at[grams] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        item, spot = items.item[flat], items.place[flat]
        doc = None
        for j in np.unique(item).tolist():
            n = int(items.ptr[j + 1] - items.ptr[j])
            most = np.zeros(n + k, np.int32)  # words of the item that any seed covers: a bound on what tiles can
            own = spot[item == j]
            np.add.at(most, own, 1)
            np.add.at(most, own + k, -1)
            if (np.cumsum(most)[:n] > 0).sum() < min_coverage * n:
                continue
            if doc is None:
                doc = np.full(int(w.ptr[row + 1] - w.ptr[row]) - k + 1, -1, np.int64)
                doc[place[a:b]] = at[a:b]
            marked, tiles = tile(doc, items.number[items.first[j] : items.first[j + 1]], k)
            if marked >= min_coverage * n:
                out.append((row, items.ids[j], marked / n, tiles, n))
    return out


def _asked(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, int]:
    """The test items, written once, and the number of blocks of BLOCK_BYTES that they make."""
    rows = benchmark.select(F.col(item).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = materialise(rows.withColumn("tag", F.monotonically_increasing_id()), "items")
    return rows, -(-(rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0) // BLOCK_BYTES)


def _one_block(rows: DataFrame, k: int) -> Items:
    got = rows.orderBy("i", "t").toArrow().combine_chunks()
    return Items(got.column("i").to_pylist(), got.column("t").combine_chunks().cast(pa.string()), k)


def _cells(batches: Iterator[pa.RecordBatch], k: int, min_coverage: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, i, t, row) in order of cell and side: each cell's items, then its documents."""
    now, held, items = None, [], None
    for batch in batches:
        cell, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            if cell[a] != now:
                now, held, items = cell[a], [], None
            part = batch.slice(a, b - a)
            if side[a] == 0:
                held.append(part.select(["i", "t"]))
                continue
            if items is None:
                got = pa.Table.from_batches(held, part.select(["i", "t"]).schema).combine_chunks()
                items = Items(got.column("i").to_pylist(), got.column("t").combine_chunks().cast(pa.string()) if got.num_rows else pa.array([], pa.string()), k)
                held = []
            for piece in slices(part):
                yield from _find(pa.RecordBatch.from_arrays([piece.column(4), piece.column(3)], names=["r", "t"]), items, min_coverage, kind)


def _find(batch: pa.RecordBatch, items: Items, min_coverage: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    hits = _hits(batch.column(1), items, min_coverage)
    if hits:
        row, item, cover, tiles, n = zip(*hits, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, kind), pa.array(cover, pa.float64()), pa.array(tiles, pa.int32()), pa.array(n, pa.int32())], names=["__row", "item_id", "coverage", "n_tiles", "item_words"])


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", k: int = K, min_coverage: float = 0.5) -> DataFrame:
    """A row for each document and test item of which it holds ``min_coverage``: key, item_id, coverage, n_tiles, item_words."""
    from pyspark.sql.pandas.types import to_arrow_type

    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind, row = benchmark.schema[item].dataType, docs.schema[key].dataType.simpleString()
    schema = f"__row {row}, item_id {kind.simpleString()}, coverage double, n_tiles int, item_words int"
    rows = docs.select(F.col(key).alias("__row"), F.col(text).cast("string").alias("__t"))
    asked, blocks = _asked(benchmark, item, item_text)
    if not blocks:
        return spark.createDataFrame([], schema).withColumnRenamed("__row", key)
    if blocks == 1:
        find = partial(_find, items=_one_block(asked, k), min_coverage=min_coverage, kind=to_arrow_type(kind))
        return arrow_map(rows, find, schema).withColumnRenamed("__row", key)
    ship(spark)
    across = max(1, -(-max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) // blocks))
    # Equal documents are dealt over all parts by the tasks that read them.
    q, c = F.pmod(F.xxhash64("tag"), F.lit(blocks)), F.pmod(F.xxhash64("__row", "__t", F.spark_partition_id()), F.lit(across))
    left = asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select((q * across + F.col("c")).alias("cell"), F.lit(0).alias("side"), "i", "t", F.lit(None).cast(row).alias("row"))
    right = rows.withColumn("c", c).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select((F.col("q") * across + F.col("c")).alias("cell"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("i"), F.col("__t").alias("t"), F.col("__row").alias("row"))
    cells = left.unionByName(right).repartitionById(blocks * across, F.col("cell").cast("int")).sortWithinPartitions("cell", "side")
    found = cells.mapInArrow(tidy(partial(_cells, k=k, min_coverage=min_coverage, kind=to_arrow_type(kind))), schema)
    return found.withColumnRenamed("__row", key)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K, min_coverage: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that hold less than ``min_coverage`` of every test item, with all their columns."""
    at = docs.columns.index(text)
    asked, blocks = _asked(benchmark, item, item_text)
    if not blocks:
        return docs
    if blocks == 1:
        items = _one_block(asked, k)

        def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            bad = {h[0] for h in _hits(batch.column(at), items, min_coverage)}
            yield batch.filter(pa.array([r not in bad for r in range(batch.num_rows)])) if bad else batch

        return arrow_map(docs, keep, StructType(docs.schema.fields))
    digest = F.md5(F.col(text).cast("string").cast("binary"))
    texts = docs.select(digest.alias("d"), F.col(text).cast("string").alias("t"))
    bad = contaminated(texts, asked.select("i", F.col("t").alias("x")), "t", "d", "i", "x", k, min_coverage).select(F.col("d").alias("__d")).distinct()
    return docs.join(small(materialise(bad, "contaminated")), digest == F.col("__d"), "left_anti")
