"""Near-duplicate documents by BagMinHash signatures of the multisets of five-word shingles.

Signature. Weights are counts, discretised exactly at the integers. For each shingle, the weight axis is cut into the
dyadic strips (0,1], (1,2], (2,4], (4,8], ... and each strip is the top of a hierarchy that carries one Poisson process
whose rate is the strip's width: points come in order of time from a generator seeded by shingle and strip, each with a
uniform level within the strip and a uniform register. A point counts in a document if the level lies under the
shingle's count there. Register r holds the earliest such point, and two documents agree in a register with probability
sum(min)/sum(max), their weighted Jaccard. Points are made only up to a horizon at which all registers are almost surely
filled, and further for documents where one isn't, so the signature is exact and its cost per document is bounded.

Candidates. Exact copies share one node, named by their text. Registers are banded (24 bands of 5: a pair of 0.8 is missed once in 14,000).
In a bucket every member is compared with the bucket's leader, its smallest member; members that end in another component
than their leader then meet all others of the bucket, block by block: first each names the nearest ones of other
components, and once these links have joined components, all that are still in another one. No pair of a bucket is made
a row unless its signatures agree enough (four standard deviations below the threshold) and its texts' parity maps, which
bound the similarity from above, allow it.

Verification counts the shingles of both texts: sum(min)/sum(max) >= threshold. Classes are connected components.

Defined cases: null, empty and wordless texts are near nothing (each row is its own class). Texts of one to four words
have one shingle. Rows of equal doc_id are one document, so its texts' classes are one; ``keep_first`` decides by texts. A
null doc_id has a null class. Extra columns stay aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import BATCH_BYTES, arrow_map, ship, slices, small, tidy
from textloom.llm.words import U, mix, shingles_of, text_bytes, words_of
from textloom.operators.components import connected_components
from textloom.session import materialise

BANDS, ROWS = 24, 5
M = BANDS * ROWS
SLACK = 0.15
MAP = 2048  # bits of a parity map
NEAREST = 3
BLOCK = 2048


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _points(h: np.ndarray, unit: np.ndarray, rate: np.ndarray, low: np.ndarray, weight: np.ndarray, horizon: np.ndarray, sig: np.ndarray) -> None:
    """Let the processes seeded by ``h`` lower the registers of their units, up to each unit's horizon."""
    t = np.zeros(len(h))
    state = mix(h ^ ((low + rate).astype(U) * U(0x8CB92BA72F3D8DD7)))  # a strip is named by its upper end
    step = 0
    while len(state):
        step += 1
        state = mix(state + U(step))
        t = t - np.log(_uniform(state)) / rate
        live = t < horizon[unit]
        state, t, unit, rate, low, weight = (x[live] for x in (state, t, unit, rate, low, weight))
        other = mix(state ^ U(0xE7037ED1A0B428DB))
        level = low + np.floor(_uniform(mix(other)) * rate) + 1
        ok = level <= weight
        np.minimum.at(sig, (unit[ok], (other[ok] % U(M)).astype(np.int64)), t[ok])


def signatures(h: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """Earliest points (n x M) of the units' multisets of shingles; rows of units without a shingle are infinite."""
    sig = np.full((n, M), np.inf)
    size = np.bincount(unit, minlength=n)
    # The strip (0, 1] asks for no count: a repeated shingle makes the same points again. Only repeated ones are counted.
    key = h ^ mix(unit.astype(U) + U(1))
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    more = np.flatnonzero(np.isin(key, twice)) if len(twice) else np.zeros(0, np.int64)
    _, first, count = np.unique(key[more], return_index=True, return_counts=True)
    mh, mu = h[more][first], unit[more][first]
    todo = np.flatnonzero(size > 0)
    want = np.log(M) + 3.0
    while len(todo):
        horizon = np.zeros(n)
        horizon[todo] = want * M / size[todo]
        ones = np.ones(len(h))
        pick = horizon[unit] > 0
        _points(h[pick], unit[pick], ones[pick], ones[pick] - 1, ones[pick], horizon, sig)
        low = 1.0
        while len(count) and count.max() > low:
            deep = (count > low) & (horizon[mu] > 0)
            k = int(deep.sum())
            _points(mh[deep], mu[deep], np.full(k, low), np.full(k, low), count[deep].astype(np.float64), horizon, sig)
            low *= 2
        todo = todo[np.isinf(sig[todo]).any(1)]
        want *= 2
    return sig


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """sum(min)/sum(max) of two multisets of hashes; 0 if both are empty."""
    x, i = np.unique(a, return_counts=True)
    y, j = np.unique(b, return_counts=True)
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(i[p], j[q]).sum())
    total = len(a) + len(b) - both
    return both / total if total else 0.0


def _parity(h: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """The units' parity maps (n x MAP / 8 bytes), made for a few units at a time, as their counts take 64 times that."""
    out = np.zeros((n, MAP // 8), np.uint8)
    spot = (mix(h ^ U(0x5851F42D4C957F2D)) % U(MAP)).astype(np.int64)
    for s in range(0, n, 256):
        e = min(s + 256, n)
        a, b = np.searchsorted(unit, (s, e))
        odd = np.bincount((unit[a:b] - s) * MAP + spot[a:b], minlength=(e - s) * MAP) & 1
        out[s:e] = np.packbits(odd.astype(np.uint8).reshape(e - s, MAP), axis=1)
    return out


def _sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    parts, at = [], 0
    for piece in slices(batch.select([1])):  # words piece by piece, signatures at once: the steps follow the longest process
        h, unit = shingles_of(words_of(*text_bytes(piece.column(0))))
        parts.append((h, unit + at))
        at += piece.num_rows
    h, unit = (np.concatenate(x) for x in zip(*parts, strict=True))
    sig = signatures(h, unit, n)
    code = (mix(sig.view(U)) >> U(48)).astype(np.uint16)
    has = ~np.isinf(sig[:, 0])
    out = [code[i].tobytes() if has[i] else None for i in range(n)]
    bits = _parity(h, unit, n)
    size = np.bincount(unit, minlength=n).astype(np.int32)
    # One value holds all that is compared: the codes, the number of shingles and the parity map.
    out = [x and x + size[i].tobytes() + bits[i].tobytes() for i, x in enumerate(out)]
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["doc", "digest", "sig"])


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Register codes, numbers of shingles and parity maps."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * M + 4 + MAP // 8)
    cut = lambda a, b, kind: np.ascontiguousarray(raw[:, a:b]).view(kind)
    return cut(0, 2 * M, np.uint16), cut(2 * M, 2 * M + 4, np.int32)[:, 0].astype(np.int64), cut(2 * M + 4, raw.shape[1], U)


def _codes(column: pa.Array) -> np.ndarray:
    return _parts(column)[0]


def _may(size_a, map_a, size_b, map_b, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold. Similar multisets differ in (1 - t) / (1 + t) of their elements at most, and
    their parity maps in no more bits than that, so no similar pair is dropped."""
    most = (1 - threshold) / (1 + threshold) * (size_a + size_b) + 1e-6
    return np.bitwise_count(map_a ^ map_b).sum(1) <= most


def _band_hashes(code: np.ndarray) -> np.ndarray:
    x = code.reshape(-1, BANDS, ROWS).astype(U)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), x.shape[:2])
    for r in range(ROWS):
        h = mix(h * U(0x9E3779B97F4A7C15) + x[:, :, r])
    return h.view(np.int64)


def _bands(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    h = _band_hashes(_codes(batch.column(1)))
    yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1)), batch.column(0).take(pa.array(np.repeat(np.arange(len(h)), BANDS)))], names=["bucket", "node"])


def _near(batch: pa.RecordBatch, least: int, threshold: float) -> Iterator[pa.RecordBatch]:
    (a, na, ma), (b, nb, mb) = _parts(batch.column(2)), _parts(batch.column(3))
    ok = pa.array(((a == b).sum(1) >= least) & _may(na, ma, nb, mb, threshold))
    yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def _within(batches: Iterator[pa.RecordBatch], least: int, threshold: float, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a block (bucket, part of the open members, part of all members): agreeing, not of one component; for
    ``nearest`` only each open member's best ones, of different components."""
    rows: list[pa.RecordBatch] = []

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        left = np.flatnonzero(t.column("side").to_numpy() == 0)
        right = np.flatnonzero(t.column("side").to_numpy() == 1)
        code, count, maps = _parts(t.column("sig").combine_chunks())
        comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        node, bucket = t.column("node").combine_chunks(), t.column("bucket")[0].as_py()
        for s in range(0, len(left), 64):
            a = left[s : s + 64]
            same = np.zeros((len(a), len(right)), np.int16)
            for r in range(M):
                same += code[a, r][:, None] == code[right, r][None, :]
            ok = (same >= least) & (comp[a][:, None] != comp[right][None, :])
            i, j = np.nonzero(ok)
            far = ~_may(count[a[i]], maps[a[i]], count[right[j]], maps[right[j]], threshold)
            ok[i[far], j[far]] = False
            i, j = i[~far], j[~far]
            if nearest and len(i):
                for _ in range(NEAREST):  # the best one of each of the nearest components
                    best = np.where(ok, same, -1).argmax(1)
                    i = np.flatnonzero(ok.any(1))
                    x, y = node.take(pa.array(a[i])), node.take(pa.array(right[best[i]]))
                    yield pa.RecordBatch.from_arrays([x, y], names=["a", "b"])
                    ok &= comp[right][None, :] != comp[right[best]][:, None]
            elif len(i):
                i, j = a[i], right[j]
                first = (_band_hashes(code[i]) == _band_hashes(code[j])).argmax(1)  # each pair from its first common band only
                ok = _band_hashes(code[i])[np.arange(len(i)), first] == bucket
                x, y = node.take(pa.array(i[ok])), node.take(pa.array(j[ok]))
                yield pa.RecordBatch.from_arrays([x, y], names=["a", "b"])

    at = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "p", "q")), strict=True))
        start = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[start]:
                if rows and at != keys[start]:
                    yield from flush(pa.Table.from_batches(rows))
                    rows = []
                at = keys[start]
                rows.append(batch.slice(start, k - start))
                start = k
    if rows:
        yield from flush(pa.Table.from_batches(rows))


def _verify(batch: pa.RecordBatch, threshold: float) -> Iterator[pa.RecordBatch]:
    both = []
    for c in (2, 3):
        h, unit = shingles_of(words_of(*text_bytes(batch.column(c))))
        at = np.searchsorted(unit, np.arange(batch.num_rows + 1))
        both.append([h[at[i] : at[i + 1]] for i in range(batch.num_rows)])
    ok = pa.array([weighted_jaccard(x, y) >= threshold for x, y in zip(*both, strict=True)], pa.bool_())
    yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def _relabel(comp: DataFrame, merged: DataFrame) -> DataFrame:
    """``comp`` (vertex, component) after its components, or vertices of none, have been joined: ``merged`` names the new
    component (component) of an old one (vertex). The members of one component are never gathered by key."""
    new = materialise(merged.select(F.col("vertex").alias("component"), F.col("component").alias("top")), "merged")
    old = comp.join(small(new), "component", "left").select("vertex", F.coalesce("top", "component").alias("component"))
    alone = new.join(comp.select("vertex"), new.component == comp.vertex, "left_anti").select(F.col("component").alias("vertex"), F.col("top").alias("component"))
    return materialise(old.unionByName(alone), "components")


def text_classes(named: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc, t, digest) with a doc: (doc and digest of those whose text has words; digest, n, doc, node and
    component of each different text). Components join the texts that chains of near copies link; n counts a text's rows,
    doc is its smallest key."""
    spark = named.sparkSession
    ship(spark)
    least = int(np.floor((threshold - SLACK) * M))
    signed = materialise(arrow_map(named, _sign, f"doc {kind}, digest string, sig binary", 2 * BATCH_BYTES), "signatures").where("sig is not null")
    nodes = signed.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    bands = arrow_map(nodes.select("node", "sig"), _bands, "bucket long, node long")
    leads = bands.groupBy("bucket").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    multi = materialise(bands.join(leads, "bucket"), "buckets")
    sa, sb = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of nodes, those whose texts hold enough shingles in common."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "doc", "digest"), "node")
        texts = named.join(asked, ["doc", "digest"]).dropDuplicates(["node"]).select("node", "t")
        wide = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
        return materialise(arrow_map(wide.select("a", "b", "ta", "tb"), partial(_verify, threshold=threshold), "a long, b long"), "links")

    pairs = multi.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    pairs = materialise(arrow_map(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb"), partial(_near, least=least, threshold=threshold), "a long, b long"), "pairs")
    tried = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    comp = materialise(connected_components(verified(pairs), "a", "b"), "components")

    # Members outside their leader's component meet all others of their bucket: first each names its nearest one there,
    # and after these links have joined components, all that are still in another component.
    for nearest in (True, False):
        label = comp.select(F.col("vertex").alias("node"), F.col("component").alias("own"))
        at = multi.join(label, "node", "left").join(label.select(F.col("node").alias("lead"), F.col("own").alias("of")), "lead", "left")
        at = at.select("bucket", "node", F.coalesce("own", "node").alias("comp"), (F.coalesce("own", "node") != F.coalesce("of", "lead")).alias("open"))
        at = materialise(at, "inside")
        todo = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("k")).where("k > 0")
        todo = materialise(todo.select("bucket", F.ceil(F.col("k") / BLOCK).cast("int").alias("np"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nq")), "open-buckets")
        if todo.isEmpty():
            break
        some = at.join(todo, "bucket").join(nodes.select("node", "sig"), "node")
        part = F.xxhash64("node", F.lit(7))
        left = some.where("open").select("bucket", F.pmod(part, F.col("np")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), F.lit(0).alias("side"), "node", "sig", "comp")
        right = some.select("bucket", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("p"), F.pmod(part, F.col("nq")).cast("int").alias("q"), F.lit(1).alias("side"), "node", "sig", "comp")
        width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        blocks = left.unionByName(right).repartition(width, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
        more = blocks.mapInArrow(tidy(partial(_within, least=least, threshold=threshold, nearest=nearest)), "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        more = materialise(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(more)
        links = verified(more)
        if links.isEmpty():
            continue
        # The new links join components: those of the smaller graph of components are looked up for each vertex.
        ends = links.join(label.select(F.col("node").alias("a"), F.col("own").alias("ca")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("own").alias("cb")), "b", "left")
        comp = _relabel(comp, connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b"))

    found = nodes.join(comp, nodes.node == comp.vertex, "left").select("digest", "n", "doc", "node", F.coalesce("component", "node").alias("component"), F.col("vertex").isNotNull().alias("linked"))
    return signed.select("doc", "digest"), materialise(found, "text-classes")


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return rows.where(F.col("doc").isNotNull()).withColumn("digest", F.md5(F.col("t").cast("binary")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """Per row: key, class_id (the smallest key among the documents linked to it by chains of near copies)."""
    kind = docs.schema[key].dataType.simpleString()
    signed, found = text_classes(_named(docs, text, key), kind, threshold)
    # Texts of one key are one document's: their components are one class.
    rows = docs.select(F.col(key).alias("doc"), F.when(F.col(key).isNotNull(), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))).alias("digest"))
    several = materialise(rows.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc"), "keys")
    if not several.isEmpty():
        ends = signed.join(small(several), "doc").distinct().join(found.select("digest", "component"), "digest")
        ends = ends.join(ends.groupBy("doc").agg(F.min("component").alias("first")), "doc")
        merged = connected_components(ends.select("component", "first"), "component", "first").select(F.col("vertex").alias("component"), F.col("component").alias("top"))
        found = found.join(small(materialise(merged, "merged")), "component", "left")
        found = materialise(found.select("digest", "n", "doc", F.coalesce("top", "component").alias("component"), (F.col("linked") | F.col("top").isNotNull()).alias("linked")), "text-classes")
    # A text of one row that nothing links is its document's own class.
    shared = found.where("linked or n > 1")
    first = materialise(shared.groupBy("component").agg(F.min("doc").alias("class_id")), "class-keys")
    by_text = materialise(shared.join(small(first), "component").select("digest", "class_id"), "class-texts")
    out = rows.join(small(by_text), "digest", "left").select("doc", F.coalesce("class_id", "doc").alias("class_id"))
    if not several.isEmpty():  # a row without words of a key that has other texts is in their class
        own = out.join(small(several), "doc").groupBy("doc").agg(F.min("class_id").alias("least"))
        out = out.join(small(materialise(own, "keys")), "doc", "left").select("doc", F.coalesce("least", "class_id").alias("class_id"))
    return out.select(F.col("doc").alias(key), "class_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest key (then the smallest MD5 of the text, then the
    smallest JSON of the row); all columns stay. It is decided by texts: rows of one key with unlike texts both stay, and
    so do rows with a null key and texts without a word, unless they repeat key and text."""
    kind = docs.schema[key].dataType.simpleString()
    _, found = text_classes(_named(docs, text, key), kind, threshold)
    shared = found.where("linked or n > 1")
    first = materialise(shared.groupBy("component").agg(F.min(F.struct("doc", "digest")).alias("x")), "class-keys")
    # Of each text of a group: the key whose row stays, or null if another text of the group does.
    by_text = shared.join(small(first), "component").select(F.col("digest").alias("__g"), F.when(F.col("digest") == F.col("x.digest"), F.col("x.doc")).alias("__k"))
    by_text = small(materialise(by_text.withColumn("__found", F.lit(True)), "class-texts"))
    names = docs.columns
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(*names, digest.alias("__d")).join(by_text, (F.col("__d") == F.col("__g")) & F.col(key).isNotNull(), "left")
    kept = rows.where(F.col("__found").isNull() | (F.col(key) == F.col("__k"))).select(*names, "__d")
    again = materialise(kept.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__a"), F.col("__d").alias("__b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "class-repeats")
    if again.isEmpty():
        return kept.select(*names)
    same = (F.col(key) == F.col("__a")) & (F.col("__d") == F.col("__b"))
    row = F.struct(*names)
    one = kept.join(small(again), same).groupBy("__a", "__b").agg(F.min_by(row, F.to_json(row)).alias("x")).select("x.*")
    return kept.join(small(again), same, "left_anti").select(*names).unionByName(one)
