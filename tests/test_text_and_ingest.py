"""Text functions, features, ingest, tokens and streaming against plain Python."""

import gzip
import json
import math
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import stable
from textloom.functions import text as T
from textloom.operators import audit, evaluation, features, ingest, tokenizer_audit, vocabulary
from textloom.sources import readers, writers
from textloom.streaming import streams

TEXTS = ["", None, "One two. Three four five! six", "Café isn't a_word 3rd. Naïve text… ok", "A.b c?  d\n\ne.", "the the the cat", "   ", "x" * 5000 + " tail.", "Ünï ÇODE words? yes! no."]


def plain(t):
    t = t or ""
    words = re.findall(r"\b[a-z]+\b", t.lower())
    sizes = [len(re.findall(r"\b[a-z]+\b", s.lower())) for s in re.split(r"[.!?]+(?:\s+|$)", t)]
    sizes = [n for n in sizes if n]
    burst = statistics.pstdev(sizes) / statistics.mean(sizes) if len(sizes) > 1 else 0.0
    n, c = len(words), Counter(words)
    return round(burst, 6), round(len(c) / math.sqrt(n), 6) if n else 0.0, round(-sum(x / n * math.log2(x / n) for x in c.values()), 6) + 0.0 if n else 0.0


def test_statistical_features_agree_with_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for r in features.statistical(df).collect():
        assert (round(r["burstiness"], 6), round(r["rttr"], 6), round(r["entropy"], 6)) == pytest.approx(plain(r["text"]), abs=2e-6), r["text"]


def test_strip_and_blank_are_unicode(spark):
    df = spark.createDataFrame([("  a b  ",), ("  ",), (None,)], "t string")
    assert [tuple(r) for r in df.select(T.strip(F.col("t")), T.is_blank(F.col("t"))).collect()] == [("a b", False), ("", True), (None, True)]


def test_vocabulary_weights_and_scores(spark):
    rows = [(0, "red red blue green"), (0, "red blue"), (1, "black black black white"), (1, "black white blue")]
    df = spark.createDataFrame(rows, "label int, text string")
    got = {r["word"]: r["weight"] for r in vocabulary.fit(df, min_freq=2, top_k=5).collect()}
    h, a = Counter("red red blue green red blue".split()), Counter("black black black white black white blue".split())
    v = len(set(h) | set(a))
    want = {w: math.log2(((a[w] + 1) / (7 + v)) / ((h[w] + 1) / (6 + v))) for w in set(h) | set(a) if h[w] + a[w] >= 2}
    assert got == pytest.approx({w: x for w, x in want.items() if x > 0})
    scored = vocabulary.score(spark.createDataFrame([("black red",), ("",), (None,)], "text string"), spark.createDataFrame([("black", 2.0)], "word string, weight double"))
    assert [r["pmi_score"] for r in scored.collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError, match="both classes"):
        vocabulary.fit(df.where("label = 0"))


def test_labels(spark):
    df = spark.createDataFrame([("0", "gpt2"), ("ODD", " Human "), ("", ""), ("ai", "human"), (None, "mpt")], "label string, model string")
    assert [r[0] for r in df.select(ingest.audit_label(F.col("label"), F.col("model"))).collect()] == [0, 0, None, 1, 1]
    quirks = spark.createDataFrame([("10",), ("said",), ("-1",), ("0",), ("",)], "label string")
    assert [r[0] for r in quirks.select(ingest.loader_label(F.col("label"), F.lit(None).cast("string"))).collect()] == [1, 1, 1, 0, 0]


def test_normalize_keeps_nulls_apart_from_empty_texts(spark):
    df = spark.createDataFrame([("a", "human", "", "fallback"), ("b", "gpt2", None, "fallback"), ("c", "gpt2", "  ", None)], "id string, model string, generation string, text string")
    assert [(r["record_id"], r["text"]) for r in ingest.normalize(df).collect()] == [("b", "fallback")]
    assert {r["id"] for r in ingest.parse(df).collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="without id or model"):
        ingest.check_raw(df.withColumn("model", F.lit("")))
    with pytest.raises(ValueError, match="missing required"):
        ingest.check_raw(df.drop("id"))


def test_pairs_and_audit(spark):
    pairs = spark.createDataFrame([("t", "h ", None), ("u", "", " ")], "page_title string, human_text string, ai_text string")
    assert sorted((r["page_title"], r["text"], r["label"]) for r in ingest.pairs_to_rows(pairs, ["page_title"]).collect()) == [("t", "h", 0), ("u", "", 1)]
    empty = spark.createDataFrame([], "id string, model string, generation string")
    s = audit.scalars(empty).first()
    assert (s["rows"], s["min_length"], s["mean_length"]) == (0, 0, 0.0)


def test_token_lengths_truncation_and_checks(spark):
    five = spark.createDataFrame([(x,) for x in range(1, 6)], "original_length int")
    s = tokenizer_audit.length_summary(five).first()
    assert (s["count"], s["median"], s["p90"]) == (5, 3.0, 4.6)
    rows = spark.createDataFrame([("a", "one two", 0), ("b", "one two three four five six", 1)], "record_id string, text string, label int")
    out = tokenizer_audit.tokenized(rows, max_length=6)
    r = tokenizer_audit.truncation(out).first()
    assert (r["rows"], r["truncated"], r["rate"]) == (2, 1, 0.5)
    first = tokenizer_audit.examples(out, "record_id").first()
    assert first["original_length"] == 4
    assert all(len(x["attention_mask"]) == 6 for x in out.collect())
    with pytest.raises(ValueError):
        tokenizer_audit.tokenized(rows, max_length=1)
    with pytest.raises(ValueError, match="bad rows"):
        tokenizer_audit.check_rows(rows.withColumn("label", F.lit(2)))


def test_json_lines_plain_and_gzip_under_any_name(spark, tmp_path):
    lines = "\n".join([json.dumps({"record_id": "a", "text": "x"}), "", json.dumps({"record_id": "b", "text": None})])
    (tmp_path / "a.jsonl").write_text(lines)
    for name in ("b.jsonl.gz", "c.jsonl"):
        (tmp_path / name).write_bytes(gzip.compress(lines.encode()))
    for name in ("a.jsonl", "b.jsonl.gz", "c.jsonl"):
        assert readers.read_jsonl(spark, f"file://{tmp_path}/{name}", "record_id string, text string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\n')
    with pytest.raises(ValueError, match="aren't objects"):
        readers.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl")


def test_csv_with_newlines_quotes_and_backslashes(spark, tmp_path):
    (tmp_path / "raid.csv").write_text('id,model,generation\n1,human,"a ""b""\nc"\n2,gpt2,back\\slash\n')
    got = readers.read_csv(spark, f"file://{tmp_path}/raid.csv")
    assert {r["id"]: r["generation"] for r in got.collect()} == {"1": 'a "b"\nc', "2": "back\\slash"}
    assert readers.find_csv(spark, f"file://{tmp_path}").endswith("raid.csv")
    assert readers.load_source(spark, "auto", f"file://{tmp_path}/raid.csv", 1).count() == 1


def test_vocabulary_round_trip(spark, tmp_path):
    words = spark.createDataFrame([("b", 1.5), ("a", 2.5)], "word string, weight double")
    writers.write_vocabulary(words, f"file://{tmp_path}/v.json")
    assert list(json.loads((tmp_path / "v.json").read_text())) == ["a", "b"]
    assert {tuple(r) for r in readers.read_vocabulary(spark, f"file://{tmp_path}/v.json").collect()} == {("b", 1.5), ("a", 2.5)}


def test_shards_and_ranks(spark):
    import hashlib

    h = hashlib.sha256(b"x").hexdigest()
    r = spark.createDataFrame([("x", h)], "i string, h string").select(stable.shard(F.col("h"), 32), stable.stable_rank(F.col("i"), 42)).first()
    assert r[0] == int(h[:8], 16) % 32 and r[1] == hashlib.sha256(b"42:x").hexdigest()


def test_chunks_and_metrics(spark):
    df = spark.createDataFrame([(1, list("abcdefg")), (2, []), (3, list("abc"))], "i int, tokens array<string>")
    got = [(r["i"], r["chunk"], "".join(r["chunk_tokens"])) for r in evaluation.chunks(df, 4, 2).orderBy("i", "chunk").collect()]
    assert got == [(1, 0, "abcd"), (1, 1, "cdef"), (1, 2, "efg"), (2, 0, ""), (3, 0, "abc")]
    scored = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, score double")
    assert evaluation.roc_auc(scored).first()["auc"] == 0.875
    assert evaluation.threshold_under_fpr(scored, 0.0).first()["threshold"] == 0.9


def test_trees_learn_and_refuse_when_untrained(spark, tmp_path):
    rows = [(float(i % 2), 0.1 * (i % 3), 1.0, 2.0, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "pmi_score double, burstiness double, rttr double, entropy double, label int")
    model = features.Detector(rounds=3)
    assert model.importance() == {}
    with pytest.raises(RuntimeError):
        model.predict(df)
    out = evaluation.by_class(model.train(df).predict(df)).collect()
    assert all(r["accuracy"] == 1.0 for r in out)
    model.save(f"file://{tmp_path}/trees")
    assert next(iter(features.Detector().load(f"file://{tmp_path}/trees").importance())) == "pmi_score"


def test_streams_dedup_what_is_there(spark, tmp_path):
    rows = [("a", "human", "same"), ("b", "human", "same"), ("c", "gpt2", "other")]
    df = spark.createDataFrame(rows, "id string, model string, generation string")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = streams.first_seen(streams.normalized(streams.read_stream(spark, f"file://{tmp_path}/in", df.schema)))
    streams.write_available(stream.select("record_id", "text_hash"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
