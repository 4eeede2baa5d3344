"""Exact nearest neighbours by largest inner product, as a block matrix join.

The queries lie in a written table, cut into blocks of bounded bytes, and the candidates are dealt to blocks as well. A
task takes one cell (query block, candidate block): it holds the queries and streams the candidates past them. Cells are
run in rounds of a few query blocks, so that only so many copies of the candidates lie on disk at once. A single block of
queries, whose bytes are measured first, goes to the tasks instead, so that candidates aren't shuffled. No more tasks
meet a query than keeps their partial results about as small as the candidates.

Within a task, a matrix covers a bounded number of pairs, whatever the blocks hold. Vectors are scaled by powers of two,
so that nothing overflows, and multiplied in float32; the rounding of such sums is at most (d + 2) u |a||b|, of which the
code takes twice as much. A pair whose upper bound lies under the query's 20th best so far is out; the surviving pairs,
and those whose sum may leave the range of doubles, are recomputed from the original components in double precision.
Each task keeps a query's best, and those of all tasks are merged by query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take
no part. Vectors are compared with vectors of their length only. No row with the query's own id is found. Rows that
repeat an id are candidates each, and each is a query of its own if its id is a query's. Ties go to the smaller id. A sum
that overflows is infinite, or not a number if both signs do; that ranks above all numbers, as in SQL. Other columns of
the frames play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import offsets_of, ship, tidy
from textloom.session import materialise

BLOCK_BYTES = 48 << 20  # of queries, with their best
ROUND = 2  # blocks of queries whose cells are on disk at once
ROWS = 8192  # candidates of a matrix
PAIRS = 1 << 21  # of a matrix
PORTION = 4 << 20  # bytes of vectors that are held in double precision at once


class Tile:
    """Vectors of one length with the powers of two that scale them, and their norms when scaled."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.power, self.size = np.zeros(len(v), np.int64), np.zeros(len(v))
        step = _step(v.shape[1])
        for at in range(0, len(v), step):
            x = v[at : at + step].astype(np.float64)
            power = np.frexp(np.abs(x).max(1))[1].astype(np.int64)
            x = np.ldexp(x, -power[:, None])  # the largest component lies in [0.5, 1)
            self.power[at : at + step], self.size[at : at + step] = power, np.sqrt((x * x).sum(1))

    def take(self, rows) -> Tile:
        out = Tile.__new__(Tile)
        out.ids, out.v, out.power, out.size = self.ids[rows], self.v[rows], self.power[rows], self.size[rows]
        return out

    @staticmethod
    def join(tiles: list[Tile]) -> Tile:
        out = Tile.__new__(Tile)
        out.ids, out.v, out.power, out.size = (np.concatenate([getattr(t, c) for t in tiles]) for c in ("ids", "v", "power", "size"))
        return out


def _step(d: int) -> int:
    return max(1, PORTION // (8 * d))


def _form(v: np.ndarray, power: np.ndarray) -> np.ndarray:
    """The scaled vectors in float32."""
    out = np.empty(v.shape, np.float32)
    step = _step(v.shape[1])
    for at in range(0, len(v), step):
        out[at : at + step] = np.ldexp(v[at : at + step].astype(np.float64), -power[at : at + step, None])
    return out


class Side:
    """Candidates, scaled by one power of two."""

    def __init__(self, tile: Tile):
        self.ids, self.v, self.power = tile.ids, tile.v, tile.power.max()
        self.form = _form(tile.v, np.broadcast_to(self.power, len(tile.ids)))
        self.size = np.ldexp(tile.size, tile.power - self.power).max()


def _scaled(a: Tile, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Approximate products of all pairs, and by query: the power of two that they are divided by, how far they may be off,
    and whether a sum might overflow."""
    d = a.v.shape[1]
    power = a.power + b.power
    share = (d + 16) * 2.0**-23 if d < 1 << 22 else np.inf
    err = share * a.size * b.size + d * 2.0**-120  # the latter for what float32 can't hold beside the largest component
    with np.errstate(under="ignore"):
        dot = _form(a.v, a.power) @ b.form.T
    return dot, power, err, power + d.bit_length() + 1 > 1022


def _least(d: int) -> float:
    """Products under the range of doubles are rounded to its last place."""
    return d * 2.0**-1073


def bounds(a: Tile, b: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of all pairs, and how far they may be off (rounding included) by row of ``a``:
    infinitely, if a sum might overflow."""
    dot, power, err, wide = _scaled(a, Side(b))
    power = np.where(wide, 0, power)
    err = np.ldexp(err, power) + _least(a.v.shape[1])
    err[wide] = np.inf
    return np.ldexp(dot.astype(np.float64), power[:, None]), err[:, None]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, summed from the first component to the last."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        x = a.astype(np.float64) * b
        return np.cumsum(x, axis=1, out=x)[:, -1] + 0.0


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """Of each entry, how many equal ones stand before it."""
    start = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return np.arange(len(sorted_keys)) - np.repeat(start, np.diff(np.r_[start, len(sorted_keys)]))


def _top(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are among their row's k best, by row and from the best, and their places: what isn't a number first,
    then the larger score, then the smaller id."""
    nan = np.isnan(score)
    order = np.lexsort((ids, np.where(nan, 0.0, -score), ~nan, row))
    r = row[order]
    place = _places(r) if len(r) else r
    keep = place < k
    return order[keep], place[keep]


class Best:
    """The k best (score, id) of every query, from the best."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.ids, self.count = np.zeros((n, k)), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        self.floor, self.last = np.full(n, -np.inf), np.zeros(n, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        full = self.count[row] == self.k
        floor = self.floor[row]
        keep = ~(full & ((score < floor) | ((score == floor) & np.isfinite(floor) & (ids > self.last[row]))))
        row, score, ids = row[keep], score[keep], ids[keep]
        if not len(row):
            return
        rows = np.unique(row)
        old, at = np.nonzero(np.arange(self.k) < self.count[rows][:, None])
        row = np.concatenate([row, rows[old]])
        score, ids = np.concatenate([score, self.score[rows[old], at]]), np.concatenate([ids, self.ids[rows[old], at]])
        which, place = _top(row, score, ids, self.k)
        row = row[which]
        self.score[row, place], self.ids[row, place] = score[which], ids[which]
        self.count[rows] = np.bincount(np.searchsorted(rows, row), minlength=len(rows))
        full = rows[self.count[rows] == self.k]
        floor = self.score[full, -1]
        self.floor[full], self.last[full] = np.where(np.isnan(floor), np.inf, floor), self.ids[full, -1]


def _useful(t: Tile, k: int) -> Tile:
    """Without rows that no query can find: of copies of a vector, the k first that don't have the query's id are among
    the 2k first, if an id counts k times at most."""
    if len(np.unique(t.size)) == len(t.ids):
        return t
    whole = np.ascontiguousarray(t.v).view(np.dtype((np.void, t.v.dtype.itemsize * t.v.shape[1]))).ravel()
    _, vector = np.unique(whole, return_inverse=True)
    order = np.lexsort((t.ids, vector))
    _, pair = np.unique(np.stack([vector[order], t.ids[order]], 1), axis=0, return_inverse=True)
    order = order[_places(pair.ravel()) < k]
    order = order[_places(vector[order]) < 2 * k]
    return t if len(order) == len(t.ids) else t.take(np.sort(order))


def search(queries: Tile, candidates: Tile, best: Best, rows: np.ndarray) -> None:
    """Let the candidates into the best of the queries (``rows``: their places in ``best``)."""
    candidates = _useful(candidates, best.k)
    if (candidates.power != candidates.power[0]).any():
        candidates = candidates.take(np.argsort(-candidates.power, kind="stable"))  # like sizes share a matrix
    d = candidates.v.shape[1]
    for at in range(0, len(candidates.ids), ROWS):
        part = Side(candidates.take(slice(at, at + ROWS)))
        step = max(1, min(PAIRS // len(part.ids), _step(d)))
        for s in range(0, len(queries.ids), step):
            _pairs(queries.take(slice(s, s + step)), part, best, rows[s : s + step])


def _pairs(queries: Tile, part: Side, best: Best, rows: np.ndarray) -> None:
    n, d, k = len(part.ids), part.v.shape[1], best.k
    dot, power, err, wide = _scaled(queries, part)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        err = err + np.ldexp(_least(d), -power)
        least = np.ldexp(best.floor[rows], -power) - err
        least[wide] = -np.inf
        alive = ~(dot < _under(least))
        many = np.flatnonzero((np.count_nonzero(alive, axis=1) > 4 * k) & ~wide) if n > 4 * k else np.zeros(0, np.int64)
        if len(many):  # the k-th best of this part is a bound as well
            own = dot[many]
            own[queries.ids[many][:, None] == part.ids] = -np.inf
            own.partition(n - k, axis=1)
            least[many] = np.fmax(least[many], own[:, n - k] - 2 * err[many])
            alive[many] = ~(dot[many] < _under(least[many]))
    i, j = np.nonzero(alive)
    del dot, alive
    step = _step(d)
    for s in range(0, len(i), step):
        a, b = i[s : s + step], j[s : s + step]
        other = queries.ids[a] != part.ids[b]
        a, b = a[other], b[other]
        best.add(rows[a], products(queries.v[a], part.v[b]), part.ids[b])


def _under(least: np.ndarray) -> np.ndarray:
    """At most the given bounds, in float32, as a column."""
    return np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]


def _tiles(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, Tile]]:
    """By length: which rows take part, and their tile."""
    kind = vectors.type.value_type
    off = offsets_of_list(vectors)
    size = np.diff(off)
    flat = vectors.values.slice(off[0], off[-1] - off[0])  # not what lies outside a slice
    off = off - off[0]
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64 if pa.types.is_float64(kind) or pa.types.is_integer(kind) else np.float32)
    ok = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid())
    key = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    for d in np.unique(size[ok & (size > 0)]).tolist():
        rows = np.flatnonzero(ok & (size == d))
        v = x[off[rows][:, None] + np.arange(d)]
        good = np.isfinite(v).all(1) & (v != 0).any(1)
        if good.any():
            out[d] = (rows[good], Tile(key[rows[good]], v[good]))
    return out


def offsets_of_list(a: pa.Array) -> np.ndarray:
    if isinstance(a, pa.LargeListArray) or isinstance(a, pa.ListArray):
        return offsets_of(a)
    raise TypeError(a.type)


class Queries:
    """A block of queries: ids, vectors and the number of each row."""

    def __init__(self, batches: list[pa.RecordBatch]):
        """Batches with the columns i, v and tag."""
        parts: dict[int, list[tuple[np.ndarray, Tile]]] = {}
        self.n, ids, tags = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                i, v, tag = (batch.slice(at, ROWS).column(c) for c in ("i", "v", "tag"))
                for d, (rows, tile) in _tiles(i, v).items():
                    parts.setdefault(d, []).append((rows + self.n, tile))
                ids.append(i.to_numpy(zero_copy_only=False))
                tags.append(tag.to_numpy(zero_copy_only=False))
                self.n += len(i)
        self.ids, self.tags = np.concatenate(ids), np.concatenate(tags)
        self.tiles = {d: (np.concatenate([r for r, _ in x]), Tile.join([t for _, t in x])) for d, x in parts.items()}


def _meet(queries: Queries, best: Best, ids: pa.Array, vectors: pa.Array) -> None:
    for d, (_, tile) in (_tiles(ids, vectors) if len(ids) else {}).items():
        if d in queries.tiles:
            rows, own = queries.tiles[d]
            search(own, tile, best, rows)


def _found(queries: Queries, best: Best) -> Iterator[pa.RecordBatch]:
    for at in range(0, queries.n, 2000):
        part = slice(at, at + 2000)
        row, place = np.nonzero(np.arange(best.k) < best.count[part][:, None])
        if len(row):
            yield _batch(tag=queries.tags[part][row], query_id=queries.ids[part][row], vec_id=best.ids[part][row, place], score=best.score[part][row, place])


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def _search(batches: Iterator[pa.RecordBatch], queries: Queries, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(queries.n, k)
    for batch in batches:
        _meet(queries, best, batch.column(0), batch.column(1))
    yield from _found(queries, best)


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, i, v, tag) in order of cell and side: each cell's queries, then its candidates."""
    now, held, queries, best = None, [], None, None
    for batch in batches:
        cell, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if cell[a] != now:
                if best is not None:
                    yield from _found(queries, best)
                now, held, queries, best = cell[a], [], None, None
            if side[a] == 0:
                held.append(part)
                continue
            if best is None:
                queries = Queries(held)
                held, best = [], Best(queries.n, k)
            _meet(queries, best, part.column(2), part.column(3))
    if best is not None:
        yield from _found(queries, best)


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of tag: the k best of each, with their ranks."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tag", "query_id", "vec_id", "score")]
        rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        cut = np.searchsorted(rows[0], rows[0][-1])
        yield from _ranked(*(x[:cut] for x in rows), k)
        rest = [x[cut:] for x in rows]  # the last tag may go on in the next batch
        keep, _ = _top(rest[0], rest[3], rest[2], k)
        rest = [x[keep] for x in rest]
    if rest is not None:
        yield from _ranked(*rest, k)


def _ranked(tag: np.ndarray, query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    keep, place = _top(tag, score, ids, k)
    if len(keep):
        yield _batch(query_id=query[keep], rank=(place + 1).astype(np.int32), vec_id=ids[keep], score=score[keep])


FOUND = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest among ``vectors``: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    pick = lambda df: df.select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v"))
    asked = pick(queries).where(F.col("i").isNotNull() & F.col("v").isNotNull())
    asked = materialise(asked.withColumn("tag", F.monotonically_increasing_id()), "queries")
    partial_schema = "tag long, query_id long, vec_id long, score double"
    n, long = asked.agg(F.count("*"), F.sum(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], FOUND)
    blocks = -(-(long * 8 + n * (64 + 16 * k)) // BLOCK_BYTES)
    rows = pick(vectors)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cores = spark.sparkContext.defaultParallelism
    # So many tasks may meet n queries: their results, 24 bytes each, take as much as the candidates' components.
    shared = rows.count() * 4 * long // (24 * k * n * n)

    def merged(found: DataFrame) -> DataFrame:
        return found.repartition(width, "tag").sortWithinPartitions("tag").mapInArrow(tidy(partial(_merge, k=k)), FOUND)

    if blocks == 1:
        block = Queries(asked.toArrow().to_batches())
        return merged(rows.coalesce(max(cores, shared)).mapInArrow(tidy(partial(_search, queries=block, k=k)), partial_schema))
    done = []
    for first in range(0, blocks, ROUND):
        # Rows of one id, or of one vector, are dealt over all candidate blocks by the tasks that read them.
        here = min(ROUND, blocks - first)
        across = max(-(-cores // here), min(-(-width // here), shared * blocks // here))
        q = F.pmod(F.xxhash64("tag"), F.lit(blocks)) - first
        left = asked.where((q >= 0) & (q < here)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select((q * across + F.col("c")).alias("cell"), F.lit(0).alias("side"), "i", "v", "tag")
        c = F.pmod(F.xxhash64("i", "v", F.spark_partition_id()), F.lit(across))
        right = rows.withColumn("c", c).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(here - 1)))).select((F.col("q") * across + F.col("c")).alias("cell"), F.lit(1).alias("side"), "i", "v", F.lit(0).cast("long").alias("tag"))
        cells = left.unionByName(right).repartitionById(here * across, F.col("cell").cast("int")).sortWithinPartitions("cell", "side")
        found = merged(cells.mapInArrow(tidy(partial(_cells, k=k)), partial_schema))
        if blocks <= ROUND:
            return found
        done.append(materialise(found, "found"))
    return spark.read.schema(FOUND).parquet(*(x._textloom_path for x in done))
