"""Quality and language: held-out accuracy, and inputs without anything to learn from."""

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def test_quality_held_out_accuracy(spark):
    out = queries.op8_quality_ranking(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    r = out.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("y")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["a"] >= 0.95 and 0 <= r["lo"] <= r["hi"] <= 1
    assert out.count() == 1000


def test_quality_without_labels_and_with_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100000), (4, "\n\n"), (4, "\n\n")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(rows) == 5 and all(abs(r["score"] - 0.5) < 1e-9 and r["predicted"] == 0 for r in rows)
    one = spark.createDataFrame([(3, 1), (4, None), (None, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, one)).count() == 5
    assert quality.score(docs.limit(0), quality.neutral()).count() == 0


def test_pairs_learn_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 3] > -1).astype(int)
    m = quality.fit_pairs(x, y)
    assert (((m.score(x) >= 0.7) == (y == 1)).mean()) > 0.93


def test_language_held_out_accuracy(spark):
    out = queries.op10_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    assert out.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.99


def test_language_spans_scripts_and_odd_texts(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog went with that", "en"), ("und der hund ist nicht mit dem", "de"), ("кот и собака идут домой вместе", "ru")] * 6)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "кот и собака"), (5, "the dog and the cat"), (6, "the " * 50000), (6, "the " * 50000)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "ru"), (5, "en"), (6, "en"), (6, "en")]
    mixed = langid.spans("the cat and the dog went with that " * 3 + "und der hund ist nicht mit dem " * 3, model)
    assert [k for _, _, k in mixed] == ["en", "de"]
    nothing = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}
    kept = langid.keep_identified(odd.withColumn("lang_pred", F.lit("clash")), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 6] and kept.columns == ["doc_id", "text", "lang_pred"]


def test_viterbi_equals_exhaustive_search():
    from itertools import product

    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        s = rng.normal(size=(n, 3)) * 3
        got = langid.viterbi(s, np.array([0, n]), 2.0)
        best = max(product(range(3), repeat=n), key=lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got) == best


def test_quality_with_very_long_words_and_clashing_columns(spark):
    rows = [(i, ("good plain words of a text " * 5) if i % 2 else "BAD !!! " * 9, "x", 3.0) for i in range(40)] + [(40, "x" * 700_000, "x", 1.0), (41, "y" * 3_000_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(out) == 42 and all(0 <= r["score"] <= 1 and np.isfinite(r["score"]) for r in out.values())
    assert all(out[i]["predicted"] == i % 2 for i in range(40)) and np.isfinite(model.weight).all()


def test_quality_sample_is_the_same_whatever_the_layout(spark):
    rows = [(i % 50, f"text {i} " * (1 + i % 7)) for i in range(400)]  # ids repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    a, b = (quality.fit(docs.repartition(n), labels, sample=30).weight for n in (1, 7))
    assert (a == b).all() and a.any()


def test_quality_gradient_and_score_equal_their_definitions():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 5)), np.arange(30) % 2
    m = quality.fit_pairs(x.astype(np.float32), y, rounds=1, batch=64, decay=0.0)
    z = (x.astype(np.float32) - x.mean(0)) / x.std(0) * 0.2
    draw = np.random.default_rng(7)
    a, b = draw.choice(np.flatnonzero(y == 1), 64), draw.choice(np.flatnonzero(y == 0), 64)
    grad = np.zeros(5)
    for i, j in zip(a, b):  # the logistic loss's gradient at weights 0, pair by pair
        grad -= (z[i] - z[j]) / 2
    step = m.weight / (0.2 / x.std(0))
    assert np.allclose(step, -0.03 * np.sign(grad), atol=1e-3)  # Adam's first step
    raw = x @ m.weight - m.shift
    want = 1 / (1 + np.exp(-(m.slope * (raw - m.cut) + np.log(0.7 / 0.3))))
    assert np.allclose(m.score(x), want)
    f = quality.features(pa.array(["ab ab cd", None, ""]))
    assert (f[1] == 0).all() and (f[2] == 0).all() and abs(f[0, -10] - 2 / 3) < 1e-6  # different words over words


def test_language_equals_brute_force(spark):
    """Counts, narrowing by script, word scores and the switching path, word by word in plain Python."""
    import pyarrow as pa

    from textloom.llm.words import text_bytes, words_of

    train = [("the cat and the dog went with that", "en"), ("und der hund ist nicht mit dem", "de"), ("кот и собака идут домой вместе", "ru"), ("le chat et le chien vont avec", "fr"), ("x1 and 22", "en")] * 3
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(train)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    texts = ["the cat und der hund", "собака the dog", "le chat and der hund ist nicht mit dem", "12 the 34 кот", "went with that собака идут домой und nicht", "κατ und", "a", "ist the ist the ist the"]

    def plain(data):
        """(bin of each byte, words): separators count as blanks."""
        w = words_of(*text_bytes(pa.array([data])))
        d = np.where(w.inside, w.data, 32).astype(np.int64).tolist()
        bins = []
        for p in range(len(d)):
            h = d[p] * 0x01000193 & 0xFFFFFFFF
            for back, mul in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
                if p >= back:
                    h ^= d[p - back] * mul & 0xFFFFFFFF
            bins.append((h * 0x27D4EB2F & 0xFFFFFFFF) >> 16)
        return bins, list(zip(w.start.tolist(), w.end.tolist())), bytes(w.data)

    langs = ["de", "en", "fr", "ru"]
    # Each text's first grams see the bytes before it in a batch, so the counts are compared for a batch of one text.
    total = {}
    langid._count(pa.RecordBatch.from_arrays([pa.array([train[0][0]]), pa.array(["en"])], names=["t", "l"]), total)
    bins, spans, _ = plain(train[0][0])
    want = np.bincount([bins[p] for a, b in spans for p in range(a, b)], minlength=langid.BINS)
    assert (total["en"][16:] == want).all() and total["en"][0] == len(spans)
    for text in texts:
        bins, spans, data = plain(text)
        scores, sizes = [], []
        for a, b in spans:
            word = data[a:b].decode()
            if not any(c.isalpha() for c in word):
                continue
            script = 1 if "а" <= word[0] <= "я" else 2 if "α" <= word[0] <= "ω" else 0
            row = [sum(float(model.logp[k][bins[p]]) for p in range(a, b)) / (b - a) * min(b - a, 12) for k in range(4)]
            if any(model.scripts[k][script] for k in range(4)):
                row = [x if model.scripts[k][script] else min(row) - 20 for k, x in enumerate(row)]
            scores.append(row)
            sizes.append(b - a)
        path = [(x, [k]) for k, x in enumerate(scores[0])]
        for row in scores[1:]:
            path = [max(((v - (12.0 if p[-1] != k else 0) + row[k], p + [k]) for v, p in path), key=lambda z: z[0]) for k in range(4)]
        best = max(path, key=lambda z: z[0])[1]
        mass = {k: sum(n for n, p in zip(sizes, best) if p == k) for k in range(4)}
        top = max(range(4), key=lambda k: (mass[k], -k))
        got = next(langid._predict(pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["r", "t"]), model, 12.0)).to_pylist()[0]
        assert got["lang_pred"] == langs[top] and abs(got["score"] - mass[top] / sum(sizes)) < 1e-9, text


def test_language_signs_without_letters_and_empty_table(spark):
    train = spark.createDataFrame([(0, "the cat and the dog", "en"), (1, "und der hund", "de")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    odd = spark.createDataFrame(list(enumerate(["😀😀 ★", "€ 100 → ★", "١٢٣", "× ÷", "5 €", "_ __", "²³", "the ★"])), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(7)) and got[7][0] == "en"
    assert langid.predict(odd.limit(0), model).count() == 0
