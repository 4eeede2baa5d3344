"""Greedy string tiling against a direct restatement, and passages out of order."""

import numpy as np
import pyarrow as pa

from textloom.llm import decontaminate
from textloom.llm.words import text_bytes, words_of

RNG = np.random.default_rng(8)


def words(n, top=400):
    return [f"v{k}" for k in RNG.integers(0, top, n)]


def covered(doc, item, k=5):
    """Greedy string tiling, longest first, by trying all places."""
    d, t = (words_of(*text_bytes(pa.array([x or ""]))).hash.tolist() for x in (doc, item))
    dm, tm = [False] * len(d), [False] * len(t)
    while True:
        best = (0, 0, 0)
        for i in range(len(d)):
            for j in range(len(t)):
                n = 0
                while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n] and not dm[i + n] and not tm[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return sum(tm) / max(len(t), 1), len(t)
        for x in range(best[0]):
            dm[best[1] + x] = tm[best[2] + x] = True


def test_coverage_equals_plain_tiling(spark):
    items = [" ".join(words(40)) for _ in range(6)] + [None, "", "too short here", "a b a b a b a b a b a b"]
    a, b = items[0].split(), items[1].split()
    docs = [
        " ".join(words(80)), items[0], " ".join(words(30) + a[20:] + words(10) + a[:20] + words(5)), " ".join(words(20) + b[:12] + words(20)), " ".join(b[:19] + words(9)), None, "", "a b " * 30,
        items[2] + " " + items[3], items[4].upper().replace(" ", ", "), " ".join(a[:10] + words(3) + a[10:20] + words(3) + a[20:]), items[0],
    ]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "'x' as item_id")
    t = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["coverage"], 9) for r in decontaminate.contaminated(d, t).collect()}
    want = {}
    for i, x in enumerate(docs):
        for j, y in enumerate(items):
            c, n = covered(x, y)
            if n >= 5 and c >= 0.5:
                want[i, j] = round(c, 9)
    assert got == want and (2, 0) in got
    kept = decontaminate.drop_contaminated(d, t)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {i for i, _ in want}


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    items = [" ".join(words(20)) for _ in range(30)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(items)] + [(99, " ".join(words(50)))], "doc_id long, text string")
    t = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, t).collect()) == [(i, i) for i in range(30)]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(d, t).collect()] == [99]
    assert decontaminate.contaminated(d, t.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), t).count() == 0
    assert decontaminate.drop_contaminated(d, t.limit(0)).count() == 31


def test_seeds_in_portions_equal_all_seeds():
    for n in (1, 2, 40):
        doc, item = RNG.integers(-1, n, 300), RNG.integers(0, n, 90)
        runs = {tuple(x) for x in zip(*(a.tolist() for a in decontaminate.runs_of(doc, item, 5)), strict=True)}
        same = (doc[:, None] == item[None, :]).tolist()
        want = set()
        for d in range(300):
            for i in range(90):
                if same[d][i] and not (d and i and same[d - 1][i - 1]):
                    m = 0
                    while d + m < 300 and i + m < 90 and same[d + m][i + m]:
                        m += 1
                    want.add((d, i, m + 4))
        assert runs == want
        assert decontaminate.tile(doc, item, 5) == decontaminate.tile(doc, item, 5, portion=7)


def test_long_repetitive_texts_take_bounded_memory():
    import resource

    items = decontaminate.Items([1], pa.array([" ".join(["a", "b"] * 400)]), 5)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = decontaminate._hits(pa.array(["a b " * 20_000, None, "c " * 50]), items, 0.5)
    assert [g[:3] for g in got] == [(0, 1, 1.0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_null_and_repeated_keys(spark):
    text = " ".join(words(30))
    d = spark.createDataFrame([(None, text), (None, text), (1, text), (1, "unlike"), (2, None)], "doc_id long, text string")
    t = spark.createDataFrame([(None, text)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"], r["coverage"]) for r in decontaminate.contaminated(d, t).collect()) == [(0, None, 1.0)] * 2 + [(1, None, 1.0)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(d, t).collect()) == [1, 2]
