"""Line dedup by an exact set-similarity join.

A line is the set of its words. It goes if an earlier line, in order of document key and place, has a Jaccard similarity
of ``threshold`` with it (equal sets have 1). Lines without a word, or of under ``min_words`` distinct words, stay.

Rarity. One pass counts words in 2**18 bins; words are ordered by their bin's count (in half powers of two), then hash.
Equal sets. Each distinct set is taken once, from its first line. Candidates. A set posts the rarest words of its probe
prefix, unless it is so small that only equal sets reach the threshold. Two sets that are similar share one of these
within the index prefix of the smaller. The members of a bucket lie in order of size, so the length filter picks a run of
them; pairs must also pass the positional filter and a bound from 128-bit parity maps of the words, which never drops a similar pair.
A later set needs only one similar earlier set, so at first each bucket names its two earliest candidates; sets that these
don't settle meet all further candidates in a second round, so no case is left out. Words whose bins count over 4,096
are counted exactly, and buckets over that are cut into blocks that meet the bucket's first members, then, for the sets
that are still open, all others. Verification compares the words of both lines.

Defined cases: null and empty texts have no lines to remove and stay. Rows of equal key and equal text are one document
and lose the same lines; rows of equal key and different texts follow one another by the text's MD5. Null keys come first.
A document all of whose lines go stays with an empty text. Lines end at a line feed. Other columns stay as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from textloom.llm._common import arrow_map, ship, slices, small, tidy
from textloom.llm.words import U, mix, text_bytes, words_of
from textloom.session import discard, materialise

BITS = 18
BATCH = 50_000
PAIRS = 1 << 16  # pairs of rows that are looked at together


@dataclass(frozen=True)
class Sizes:
    """What changes the cost and not the result: members from which a bucket is crowded, how many first members its
    blocks meet, and how many candidates a set names in the first round."""

    crowd: int = 4096
    leads: int = 1024
    earliest: int = 2


def _lines(column: pa.Array):
    """The words of all lines of a batch: words, the row of each line and its number in the row."""
    data, off = text_bytes(column)
    brk = np.flatnonzero(data == 10) + 1
    at = np.union1d(off, brk) if len(data) else off[:1]
    at = at.astype(np.int64)
    row = np.searchsorted(off, at[:-1], "right") - 1
    first = np.searchsorted(at, off[:-1])
    number = np.arange(len(at) - 1) - first[row] if len(at) > 1 else np.zeros(0, np.int64)
    return words_of(data, at), row, number


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the hash bins, in 64 pieces of 4,096."""
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for piece in slices(batch):
            w = words_of(*text_bytes(piece.column(0)))
            total += np.bincount((w.hash >> U(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in total.reshape(64, -1)], pa.binary())], names=["part", "n"])


def _sum_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces that meet in a task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(n, np.int64)
            total[p] = total[p] + x if p in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "n"])


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often words of each bin occur in all texts."""
    rows = docs.select(F.col(text).cast("string").alias("t"))
    schema = "part int, n binary"
    parts = rows.mapInArrow(tidy(_bins), schema).repartition(64, "part", F.pmod(F.spark_partition_id(), F.lit(8))).mapInArrow(tidy(_sum_bins), schema).toArrow()
    out = np.zeros((64, (1 << BITS) // 64), np.int64)
    for p, n in zip(parts.column("part").to_pylist(), parts.column("n").to_pylist(), strict=True):
        out[p] += np.frombuffer(n, np.int64)
    return out.reshape(-1)


def needed(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _sets(w, level: np.ndarray | None):
    """The distinct words of each line in order of rarity (or of hash): hashes, line of each."""
    unit, h = w.unit(), w.hash
    top = h >> U(64 - BITS)
    rank = level[top.astype(np.int64)].astype(U) if level is not None else np.zeros(len(h), U)
    wide = len(w.ptr) > (1 << 20)
    key = (unit.astype(U) << U(44)) | (rank << U(38)) | (h >> U(26))
    order = np.argsort(key)
    k, hs = key[order], h[order]
    if wide or ((k[1:] == k[:-1]) & (hs[1:] != hs[:-1])).any():
        order = np.lexsort((h, rank, unit))
        hs = h[order]
    us = unit[order]
    keep = np.ones(len(hs), bool)
    keep[1:] = (us[1:] != us[:-1]) | (hs[1:] != hs[:-1])
    return hs[keep], us[keep]


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(2 * np.log2(counts + 1.0)), 63).astype(np.int64)


def _describe(batch: pa.RecordBatch, counts: np.ndarray, threshold: float, min_words: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """A row for each line that takes part."""
    w, row, number = _lines(batch.column(1))
    if not len(w.hash):
        return
    level = _levels(counts)
    h, unit = _sets(w, level)
    at = np.searchsorted(unit, np.arange(len(row) + 1))
    size = np.diff(at)
    pick = np.flatnonzero(size >= max(min_words, 1))
    if not len(pick):
        return
    begin = at[pick]
    n = size[pick]
    mixed = mix(h)
    run1 = np.concatenate([np.zeros(1, U), np.cumsum(mixed, dtype=U)])
    run2 = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), dtype=U)])
    h1, h2 = run1[begin + n] - run1[begin], run2[begin + n] - run2[begin]
    place = mixed & U(127)
    flag = U(1) << (place & U(63))
    nonempty = np.flatnonzero(size > 0)
    maps = np.zeros((2, len(size)), U)
    for k in range(2):
        maps[k, nonempty] = np.bitwise_xor.reduceat(np.where(place >> U(6) == k, flag, U(0)), at[:-1][nonempty])
    probe = np.where(needed(n + 1, threshold) <= n, n - needed(n, threshold) + 1, 0)  # 0: one word more or less is too far
    flat = np.repeat(begin - (np.cumsum(probe) - probe), probe) + np.arange(int(probe.sum()))
    words = h[flat]
    heavy = level[(words >> U(64 - BITS)).astype(np.int64)] >= _levels(np.array(crowd))
    ptr = np.concatenate([[0], np.cumsum(probe)])
    light = np.diff(np.concatenate([[0], np.cumsum(~heavy)])[ptr])
    yield pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(row[pick])),
            pa.array(number[pick], pa.int64()),
            pa.array(h1.view(np.int64)),
            pa.array(h2.view(np.int64)),
            pa.array(n, pa.int32()),
            pa.array(maps[0, pick].view(np.int64)),
            pa.array(maps[1, pick].view(np.int64)),
            pa.array(light, pa.int32()),
            pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(words.view(np.int64))),
        ],
        names=["d", "lo", "h1", "h2", "size", "bits", "bits2", "light", "prefix"],
    )


def _pairs(size: np.ndarray, pos: np.ndarray, bucket: np.ndarray, role: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket that pass the length, prefix and positional filters, in runs of bounded size. Rows are
    sorted by bucket, then size, so the partners of a row lie in one run; of each pair one row at least may be the later."""
    index = size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64) + 1  # the prefix of the smaller
    key = bucket * (1 << 33) + size
    top = bucket * (1 << 33) + np.floor(size / threshold + 1e-9).astype(np.int64)
    rows = np.arange(len(size))
    every = bool((role == 3).all())
    if every:  # look around among larger rows only
        own, other = np.flatnonzero(pos < index), rows
        first, last = own + 1, np.searchsorted(key, top[own], "right")
    else:  # few may be the later: only these look around, among those that may be the earlier
        own, other = np.flatnonzero(role & 2 > 0), np.flatnonzero(role & 1 > 0)
        first = np.searchsorted(key[other], (bucket * (1 << 33) + needed(size, threshold))[own], "left")
        last = np.searchsorted(key[other], top[own], "right")
    count = np.maximum(last - first, 0)
    done = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(own):
        end = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
        n = count[at:end]
        i = np.repeat(own[at:end], n)
        j = other[np.arange(int(done[end] - done[at])) + np.repeat(first[at:end] - (done[at:end] - done[at]), n)]
        at = end
        a, b = size[i], size[j]
        if not every:  # a pair of two that ask comes once only
            ok = np.where(a <= b, pos[i] < index[i], pos[j] < index[j]) & ((role[i] & 1 == 0) | (role[j] & 2 == 0) | (i < j)) & (i != j)
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        alpha = np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)
        ok = np.flatnonzero(np.minimum(a - pos[i], b - pos[j]) >= alpha)
        yield i[ok], j[ok]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, earliest: int | None) -> Iterator[pa.RecordBatch]:
    """Candidates of rows that come bucket by bucket (word, p, q): later, earlier and whether the later set has further
    candidates in the bucket. ``role``: 1 may be the earlier, 2 the later, 3 (if absent) either."""

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        same = np.ones(t.num_rows + 1, bool)  # does a row continue the bucket of the row before?
        same[0] = same[-1] = False
        for c in ("word", "p", "q"):
            if c in t.column_names:
                same[1:-1] &= np.diff(t.column(c).to_numpy()) == 0
        bucket = np.cumsum(~same[:-1])
        some = np.flatnonzero(same[:-1] | same[1:])  # a row alone meets nothing
        if not len(some):
            return
        t, bucket = t.take(pa.array(some)).combine_chunks(), bucket[some]
        size = t.column("sp").to_numpy() >> 32
        order = np.lexsort((size, bucket))
        t, bucket, size = t.take(pa.array(order)).combine_chunks(), bucket[order], size[order]
        col = {c: t.column(c).to_numpy() for c in t.column_names}
        n = len(size)
        pos = col["sp"] & 0xFFFFFFFF
        role = col["role"].astype(np.int64) if "role" in col else np.full(n, 3)
        bits, bits2 = col["bits"].view(U), col["bits2"].view(U)
        when = np.empty(n, np.int64)  # place in the order of sets; the rows of one set have the same
        order = np.lexsort((col["lo"], col["d"]))
        when[order] = np.cumsum(np.concatenate([[False], (np.diff(col["d"][order]) != 0) | (np.diff(col["lo"][order]) != 0)]))
        later, earlier = [], []
        for i, j in _pairs(size, pos, bucket, role, threshold):
            a, b = size[i], size[j]
            far = (a + b - 2 * np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)).astype(np.int64)
            ok = np.bitwise_count(bits[i] ^ bits[j]).astype(np.int64) + np.bitwise_count(bits2[i] ^ bits2[j]) <= far
            i, j = i[ok], j[ok]
            swap = when[i] > when[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            ok = (when[i] != when[j]) & (role[i] & 1 > 0) & (role[j] & 2 > 0)  # a crowded block may hold a set in both roles
            earlier.append(i[ok])
            later.append(j[ok])
        if not later or not sum(map(len, later)):
            return
        i, j = np.concatenate(earlier), np.concatenate(later)
        order = np.lexsort((when[i], j))
        i, j = i[order], j[order]
        more = col["more"][j].copy() if "more" in col else np.zeros(len(j), bool)
        if earliest is not None:
            first = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))
            count = np.diff(np.append(first, len(j)))
            more |= np.repeat(count > earliest, count)
            keep = np.arange(len(j)) - np.repeat(first, count) < earliest
            i, j, more = i[keep], j[keep], more[keep]
        yield pa.RecordBatch.from_arrays([pa.array(col[c][x]) for c, x in (("d", j), ("lo", j), ("d", i), ("lo", i), ("word", j))] + [pa.array(more)], names=["bd", "blo", "ad", "alo", "word", "more"])

    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < BATCH:
            continue
        t = pa.concat_tables(held).combine_chunks()
        key = [t.column(c).to_numpy() for c in ("word", "p", "q") if c in t.column_names]
        same = np.logical_and.reduce([k == k[-1] for k in key])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last bucket begins
        if cut:
            yield from flush(t.slice(0, cut))
        held = [t.slice(cut)]
    if held:
        yield from flush(pa.concat_tables(held).combine_chunks())


_PAIR = "bd long, blo long, ad long, alo long, word long, more boolean"


def _meet(rows: DataFrame, threshold: float, earliest: int | None) -> DataFrame:
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = [c for c in ("word", "p", "q") if c in rows.columns]
    more = [c for c in ("role", "more") if c in rows.columns]
    # Sorted by bucket only: one column of numbers goes through the radix sort.
    return rows.select(*bucket, "d", "lo", "sp", "bits", "bits2", *more).repartition(width, *bucket).sortWithinPartitions(*bucket).mapInArrow(tidy(partial(_compare, threshold=threshold, earliest=earliest)), _PAIR)


def _posted(sets: DataFrame) -> DataFrame:
    """A row for each word of each set's prefix."""
    one = sets.select("d", "lo", "size", "bits", "bits2", "light", F.posexplode("prefix").alias("pos", "word"))
    return one.select("word", "d", "lo", F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("sp"), "bits", "bits2", (F.col("pos") >= F.col("light")).alias("heavy"))


def _first_round(sets: DataFrame, crowded: DataFrame | None, threshold: float, size: Sizes) -> DataFrame:
    posts = _posted(sets)
    if crowded is None:
        return _meet(posts, threshold, size.earliest)
    few = posts.join(crowded, "word", "left_anti")
    out = _meet(few, threshold, size.earliest)
    many = posts.where("heavy").join(crowded, "word")
    # A bucket's first members: the least of each of 64 parts, then the least of those.
    order = (F.col("d"), F.col("lo"))
    part = F.row_number().over(Window.partitionBy("word", F.pmod(F.xxhash64("d", "lo"), F.lit(64))).orderBy(*order))
    leads = many.withColumn("r", part).where(F.col("r") <= size.leads).withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where(F.col("r") <= size.leads)
    own = many.withColumns({"p": F.pmod(F.xxhash64("d", "lo"), F.col("blocks")).cast("int"), "q": F.lit(0), "role": F.lit(2), "more": F.lit(True)})
    lead = leads.withColumns({"p": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "q": F.lit(0), "role": F.lit(1), "more": F.lit(False)})
    names = ["word", "p", "q", "d", "lo", "sp", "bits", "bits2", "role", "more"]
    return out.unionByName(_meet(own.select(*names).unionByName(lead.select(*names)), threshold, size.earliest))


def _second_round(sets: DataFrame, crowded: DataFrame | None, waiting: DataFrame, threshold: float, size: Sizes) -> DataFrame:
    """All candidates of the waiting sets (word, d, lo)."""
    posts = _posted(sets).join(small(materialise(waiting.select("word").distinct(), "line-words")), "word", "left_semi")
    posts = posts.join(small(waiting).withColumn("w", F.lit(True)), ["word", "d", "lo"], "left")
    role = F.when(F.col("w"), 3).otherwise(1)
    few = posts if crowded is None else posts.join(crowded, "word", "left_anti")
    out = _meet(few.withColumn("role", role), threshold, None)
    if crowded is None:
        return out
    many = posts.join(crowded, "word")
    n = many.where("w").groupBy("word").agg(F.ceil(F.count(F.lit(1)) / size.crowd).cast("int").alias("np"))
    many = many.join(n, "word")
    hash_ = F.xxhash64("d", "lo")
    left = many.where("w").withColumns({"p": F.pmod(hash_, F.col("np")).cast("int"), "q": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "role": F.lit(2), "more": F.lit(False)})
    right = many.withColumns({"p": F.explode(F.sequence(F.lit(0), F.col("np") - 1)), "q": F.pmod(hash_, F.col("blocks")).cast("int"), "role": F.lit(1), "more": F.lit(False)})
    names = ["word", "p", "q", "d", "lo", "sp", "bits", "bits2", "role", "more"]
    return out.unionByName(_meet(left.select(*names).unionByName(right.select(*names)), threshold, None))


def _words_of_lines(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The distinct word hashes of the asked lines (column 1: their numbers) of each text, in order."""
    w, row, number = _lines(batch.column(2))
    asked = batch.column(1).to_pylist()
    want = np.zeros(len(row), bool)
    first = np.searchsorted(row, np.arange(batch.num_rows))
    for r, lines in enumerate(asked):
        want[first[r] + np.array(lines, np.int64)] = True
    h, unit = _sets(w, None)
    at = np.searchsorted(unit, np.arange(len(row) + 1))
    pick = np.flatnonzero(want)
    sets = [np.sort(h[at[i] : at[i + 1]]).tobytes() for i in pick.tolist()]
    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[pick])), pa.array(number[pick], pa.int64()), pa.array(sets, pa.binary())], names=["d", "lo", "words"])


def _similar(batch: pa.RecordBatch, threshold: float) -> Iterator[pa.RecordBatch]:
    ok = []
    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        a, b = np.frombuffer(x, U), np.frombuffer(y, U)
        both = len(np.intersect1d(a, b, assume_unique=True))
        ok.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
    keep = pa.array(ok, pa.bool_())
    yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["d", "lo"])


def removed_lines(docs: DataFrame, text: str, key: str, threshold: float, min_words: int, size: Sizes) -> tuple[DataFrame, DataFrame]:
    """(documents as __d and all columns; d and the numbers of the lines to remove)."""
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns
    full = F.coalesce(F.col(text).cast("string"), F.lit(""))
    repeated = not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if isinstance(docs.schema[key].dataType, IntegralType) and not repeated:
        keyed = docs.withColumn("__d", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))))
    else:  # other keys, and the texts of one key by their hash, are numbered in their order
        ids = docs.select(F.col(key).alias("__k"), F.md5(full.cast("binary")).alias("__t"))
        numbered = ids.distinct().orderBy("__k", "__t").withColumn("__d", F.monotonically_increasing_id())
        numbered = materialise(numbered, "line-keys")
        keyed = docs.join(numbered, F.col(key).eqNullSafe(F.col("__k")) & (F.md5(full.cast("binary")) == F.col("__t"))).drop("__k", "__t")
    keyed = keyed.select("__d", *names)
    rows = keyed.select(F.col("__d").alias("d"), full.alias("t"))

    counts = rarity(rows, "t")
    schema = "d long, lo long, h1 long, h2 long, size int, bits long, bits2 long, light int, prefix array<long>"
    lines = materialise(arrow_map(rows, partial(_describe, counts=counts, threshold=threshold, min_words=min_words, crowd=size.crowd), schema), "lines")
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("d", "lo"))
    sets = materialise(lines.withColumn("r", first).where("r = 1").drop("r"), "line-sets")

    heavy = _posted(sets.where(F.size("prefix") > F.col("light"))).where("heavy").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size.crowd)
    crowded = materialise(heavy.select("word", F.ceil(F.col("n") / size.crowd).cast("int").alias("blocks")), "crowded")
    crowded = None if crowded.isEmpty() else small(crowded)

    def verified(pairs: DataFrame) -> DataFrame:
        """(d, lo) of the later sets of those pairs whose words agree enough."""
        ids = pairs.select(F.col("bd").alias("d"), F.col("blo").alias("lo")).union(pairs.select("ad", "alo")).distinct()
        asked = small(materialise(ids.groupBy("d").agg(F.collect_list("lo").alias("lines")), "line-asked"))
        found = rows.join(asked, "d").dropDuplicates(["d"]) if repeated else rows.join(asked, "d")
        words = materialise(arrow_map(found.select("d", "lines", "t"), _words_of_lines, "d long, lo long, words binary"), "line-words")
        a = words.select(F.col("d").alias("ad"), F.col("lo").alias("alo"), F.col("words").alias("aw"))
        b = words.select(F.col("d").alias("bd"), F.col("lo").alias("blo"), F.col("words").alias("bw"))
        wide = pairs.join(a, ["ad", "alo"]).join(b, ["bd", "blo"]).select("bd", "blo", "aw", "bw")
        out = materialise(arrow_map(wide, partial(_similar, threshold=threshold), "d long, lo long").distinct(), "line-similar")
        discard(words)
        return out

    named = materialise(_first_round(sets, crowded, threshold, size), "line-candidates")
    gone = verified(named.select("bd", "blo", "ad", "alo").distinct())
    waiting = named.where("more").select("word", F.col("bd").alias("d"), F.col("blo").alias("lo"))
    if crowded is not None:  # members of a crowded bucket may have candidates beyond the first members
        waiting = waiting.union(_posted(sets.where(F.size("prefix") > F.col("light"))).join(crowded, "word").select("word", "d", "lo"))
    waiting = materialise(waiting.distinct().join(gone, ["d", "lo"], "left_anti").select("word", "d", "lo"), "line-waiting")
    if not waiting.isEmpty():
        rest = _second_round(sets, crowded, waiting, threshold, size).select("bd", "blo", "ad", "alo").distinct()
        rest = materialise(rest.join(named.select("bd", "blo", "ad", "alo"), ["bd", "blo", "ad", "alo"], "left_anti"), "line-candidates")
        if not rest.isEmpty():
            gone = materialise(gone.union(verified(rest)).distinct(), "line-similar")
    discard(named)

    kept = sets.select("h1", "h2", F.col("d").alias("sd"), F.col("lo").alias("slo")).join(gone.select(F.col("d").alias("sd"), F.col("lo").alias("slo"), F.lit(True).alias("gone")), ["sd", "slo"], "left")
    out = lines.select("d", "lo", "h1", "h2").join(kept, ["h1", "h2"]).where("gone or d <> sd or lo <> slo")
    out = out.groupBy("d").agg(F.array_sort(F.collect_set(F.col("lo").cast("int"))).alias("removed"))
    return keyed, materialise(out, "line-removed")


def _cut(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Take the removed lines (the last column) out of the text (column ``at``)."""
    gone = batch.column(batch.num_columns - 1)
    rows = np.flatnonzero(np.asarray(gone.is_valid()))
    if len(rows):
        where = pa.array(rows)
        texts, drops = batch.column(at).take(where).to_pylist(), gone.take(where).to_pylist()
        new = ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in d) for t, d in zip(texts, map(set, drops), strict=True)]
        cut = pc.replace_with_mask(batch.column(at), gone.is_valid(), pa.array(new, batch.column(at).type))
        batch = batch.set_column(at, batch.schema.names[at], cut)
    yield batch


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, min_words: int = 5, size: Sizes = Sizes()) -> DataFrame:
    """``docs`` with later matching lines removed from ``text``, and columns n_lines and removed (line numbers from 0)."""
    keyed, gone = removed_lines(docs, text, key, threshold, min_words, size)
    plain = [c for c in docs.columns if c not in ("n_lines", "removed")]
    side = small(gone.select(F.col("d").alias("__gd"), F.col("removed").alias("__gone")))
    out = keyed.join(side, F.col("__d") == F.col("__gd"), "left")
    n = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    out = out.select(*plain, n.alias("n_lines"), F.col("__gone").alias("removed"))
    out = arrow_map(out, partial(_cut, at=plain.index(text)), out.schema)
    return out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
