"""Near copies and repeated lines against brute force, with hot groups."""

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import line_dedup, minhash
from textloom.llm.words import shingles_of, text_bytes, words_of

RNG = np.random.default_rng(11)
VOCABULARY = [f"w{k}" for k in range(2000)]


def words(n):
    return [VOCABULARY[k] for k in RNG.integers(0, len(VOCABULARY), n)]


def edited(base, most):
    w = list(base)
    for j in RNG.integers(0, len(w), RNG.integers(0, most + 1)):
        w[j] = VOCABULARY[RNG.integers(0, len(VOCABULARY))]
    return w


def classes(rows):
    column = pa.array([t for _, t in rows], pa.string())
    h, u = shingles_of(words_of(*text_bytes(column)))
    at = np.searchsorted(u, np.arange(len(rows) + 1))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if minhash.weighted_jaccard(h[at[i] : at[i + 1]], h[at[j] : at[j + 1]]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_near_copies_equal_brute_force(spark):
    base = words(120)
    texts = [" ".join(edited(base, 7)) for _ in range(90)] + [" ".join(words(60)) for _ in range(20)]
    texts += [*texts[:4], "", None, "one two", "One  two!", "a b c d e f", "x " * 300, "x " * 290]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class_id", "2 as node")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == classes(rows)
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_near_copies_of_repeated_and_null_keys(spark):
    t = " ".join(words(50))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, "other text of its own here")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, None), (3, 3)], key=str)
    assert sorted((r["doc_id"] or 0) for r in minhash.keep_first(df).collect()) == [0, 1, 3]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_copies_are_found_by_text_whatever_keys_repeat(spark):
    a, b, c, d = (" ".join(words(40)) for _ in range(4))
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, b), (4, a), (7, c), (7, d), (7, d), (8, d), (9, ""), (9, c), (10, ""), (10, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7), (10, 10)}
    kept = sorted((r["doc_id"], r["text"]) for r in minhash.keep_first(df).collect())
    assert kept == sorted([(1, a), (1, b), (7, c), (7, d), (9, ""), (10, "")])


def test_repeated_rows_leave_the_same_one(spark):
    t = " ".join(words(40))
    df = spark.createDataFrame([(1, t, {"k": "b"}), (1, t, {"k": "a"}), (2, t, None)], "doc_id long, text string, m map<string,string>")
    for parts in (1, 3):
        assert [(r["doc_id"], r["m"]) for r in minhash.keep_first(df.repartition(parts)).collect()] == [(1, {"k": "a"})]


def test_recall_of_pairs_at_and_above_the_threshold(spark):
    """Pairs of texts of a known similarity, near the threshold: at least 0.99 of them are found."""
    rows, want = [], 0
    for k in range(400):
        base = [f"u{k}x{j}" for j in range(150)]
        twin = list(base)
        for e in range(1 + k % 3):
            twin[20 + 45 * e] = f"v{k}x{e}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(twin))]
    column = pa.array([t for _, t in rows])
    h, u = shingles_of(words_of(*text_bytes(column)))
    at = np.searchsorted(u, np.arange(len(rows) + 1))
    similar = [minhash.weighted_jaccard(h[at[2 * k] : at[2 * k + 1]], h[at[2 * k + 1] : at[2 * k + 2]]) for k in range(400)]
    want = {2 * k + 1 for k in range(400) if similar[k] >= 0.8}
    assert len(want) > 300 and min(s for s in similar if s >= 0.8) < 0.83
    got = {r["doc_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("class_id <> doc_id").collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_a_very_long_text_has_its_near_copy(spark):
    w = [f"t{k % 5000}y{k % 7}" for k in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:30_000], "other", *w[30_001:]])), (3, " ".join(w[::-1]))]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_signatures_estimate_weighted_jaccard():
    a, b = np.repeat(np.arange(400, dtype=np.uint64), 3), np.repeat(np.arange(100, 500, dtype=np.uint64), 2)
    want = 300 * 2 / (100 * 3 + 300 * 3 + 100 * 2)
    h, u = np.concatenate([a, b] * 30), np.repeat(np.arange(60), np.tile([len(a), len(b)], 30))
    h = h ^ (u // 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = minhash.signatures(h, u, 60)
    assert abs((s[::2] == s[1::2]).mean() - want) < 0.03


def gone(rows, threshold=0.8, least=5):
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words_of(*text_bytes(pa.array([line]))).hash.tolist())
            if len(s) >= least:
                if any(len(s & o) >= threshold * len(s | o) - 1e-9 for o in seen):
                    out.setdefault(d, []).append(k)
                seen.append(s)
    return out


@pytest.mark.parametrize("size", [line_dedup.Sizes(), line_dedup.Sizes(8, 3, 1)])
def test_lines_equal_brute_force(spark, size):
    base = words(30)
    rows = [(d, "\n".join([" ".join(edited(base, 4)), " ".join(words(12)), "short line", " ".join(words(250))])) for d in range(60)]
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "\n\n"), (104, rows[1][1] + "\n"), (105, " ".join(words(6)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as removed", "7 as line", "8 as d")
    out = line_dedup.dedup_lines(df, size=size).collect()
    want = gone(rows)
    assert {r["doc_id"]: r["removed"] for r in out if r["removed"]} == want
    texts = dict(rows)
    for r in out:
        t = texts[r["doc_id"]]
        assert r["text"] == (t if t is None or r["doc_id"] not in want else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[r["doc_id"]]))
        assert r["n_lines"] == (len(t.split("\n")) if t else 0)


def test_lines_of_repeated_null_and_text_keys(spark):
    t = " ".join(words(20))
    df = spark.createDataFrame([("b", t), ("a", t), ("a", t), ("a", "another line that has enough words"), (None, t)], "doc_id string, text string")
    out = sorted(((r["doc_id"], len(r["removed"])) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert out == sorted([("b", 1), ("a", 1), ("a", 1), ("a", 0), (None, 0)], key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("others", [0, 200])
def test_a_set_in_both_roles_of_a_block_is_not_its_own_match(others):
    n = others + 2  # the set as earlier one (role 1), then as later one (role 2), in a light and in a long bucket
    low = np.array([0, 0, *range(1, others + 1)])
    col = {"word": np.full(n, 7), "p": np.zeros(n, np.int64), "q": np.zeros(n, np.int64), "d": np.full(n, 3), "lo": low, "sp": np.full(n, 10 << 32), "bits": np.zeros(n, np.int64), "bits2": np.zeros(n, np.int64), "role": np.array([1, *[2] * (n - 1)]), "more": np.zeros(n, bool)}
    got = [r for b in line_dedup._compare(iter([pa.RecordBatch.from_pydict(col)]), 0.8, None) for r in b.to_pylist()]
    assert sorted((r["blo"], r["alo"]) for r in got) == [(k, 0) for k in range(1, others + 1)]


@pytest.mark.parametrize("size", [line_dedup.Sizes(), line_dedup.Sizes(8, 3, 1)])
def test_short_lines_equal_brute_force(spark, size):
    few = [f"v{k}" for k in range(7)]
    rows = [(d, "\n".join([" ".join(few[k] for k in RNG.integers(0, 7, RNG.integers(1, 7))) for _ in range(3)] + ["", "---", "All rights reserved."])) for d in range(80)]
    rows += [(200, "one two three four"), (201, "four three two one zero"), (202, "ภาษาไทย"), (203, "ภาษาไทย"), (204, "zero!"), (205, "Zero")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), size=size, min_words=1).collect()
    want = gone(rows, least=1)
    assert {r["doc_id"]: r["removed"] for r in out if r["removed"]} == want
    assert want[201] == want[203] == want[205] == [0] and want[79][-1] == 5 and not any({3, 4} & set(x) for x in want.values())


def test_query_and_pipeline_remove_short_repeats(spark, tmp_path):
    import corpus_pipeline
    from textloom.llm import queries

    rows = [(1, "All rights reserved.", "en", "s", 20), (2, "All rights reserved.\nmore", "en", "s", 25)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["text"] for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()} == {1: rows[0][1], 2: "more"}
    out = corpus_pipeline.lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out} == {1: (rows[0][1], 20), 2: ("more", 4)}
