"""Command line, reports, streams with quarantine, and functions that must fail on bad input."""

import json

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.functions import measures
from textloom.functions import text as T
from textloom.operators import audit, evaluation, features, manifest, pilot, splits, tokenizer_audit, vocabulary
from textloom.sources import readers, writers
from textloom.streaming import streams

RAW = "id string, source_id string, adv_source_id string, model string, decoding string, repetition_penalty string, attack string, domain string, title string, prompt string, generation string"


def raw(spark, n=80):
    rows = [(f"r{k:03d}", f"s{k // 2}", f"s{k // 2}", "human" if k % 2 else ("gpt2", "mpt")[k // 2 % 2], None, None, "none" if k % 3 else "synonym", ("news", "books")[k // 4 % 2], "t", None, f'text {k}, with "quotes"\nand lines') for k in range(n)]
    return spark.createDataFrame(rows, RAW)


def test_command_line_end_to_end(spark, tmp_path):
    base = f"file://{tmp_path}"
    writers.write_csv(raw(spark), f"{base}/raw.csv")
    made = cli.run(spark, ["manifest", "--source", f"{base}/raw.csv", "--output", f"{base}/m", "--shards", "3"])
    assert made["removed"]["rows_kept"] == 80 and sum(x["rows"] for x in made["splits"].values()) == 80
    index = json.loads((tmp_path / "m/shard_index.json").read_text())
    assert sum(x["rows"] for x in index["files"]) == 80 and index["shards"] == 3 and json.loads((tmp_path / "m/config.json").read_text())["seed"] == 42
    found = cli.run(spark, ["pilot", "--assignments", f"{base}/m", "--output", f"{base}/p", "--target-rows", "20"])
    assert found["pilot"]["human"] == found["pilot"]["ai"] == 10 and found["overlap"] == {"validation": 0, "test": 0}
    assert json.loads((tmp_path / "p/pilot_summary.json").read_text())["rows"] == 20
    joined = cli.run(spark, ["join", "--source", f"{base}/raw.csv", "--pilot", f"{base}/p/pilot_assignments", "--output", f"{base}/j"])
    assert joined["joined"] == joined["assignments"] == 20 and joined["labels"] == {"0": 10, "1": 10}
    texts = spark.read.json(f"{base}/j/pilot_texts")
    assert texts.where("attack is null").count() == 0 and texts.where("text like '%\n%'").count() == 20
    said = cli.run(spark, ["audit", "--source", f"{base}/raw.csv", "--output", f"{base}/audit.json"])
    assert said["data"]["rows"] == 80 and said["observed_fields"] == sorted(RAW.replace(" string", "").split(", ")) and said["runtime"]["spark"] == spark.version
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["manifest", "--source", "x", "--output", "y", "--shards", "0"])


def test_measures_equal_the_column_functions(spark):
    texts = ["One two. Three four five! Six?", "", None, "no stop", "a.b.c. İstanbul KELVIN K x́y ünï_1 ab", "Wait... what?! yes no. Go", "x\x1cy. z", "tail. ", "123 4ab c_d e"] + ["w%d a b. " % k * (k + 1) for k in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    text = F.coalesce("text", F.lit(""))
    want = df.select("i", T.burstiness(text).alias("burstiness"), T.rttr(T.word_stats(text)).alias("rttr"), T.entropy(T.word_stats(text)).alias("entropy"))
    got = {r["i"]: r for r in features.statistical(df.withColumn("rttr", F.lit("clash"))).collect()}
    for r in want.collect():
        assert all(abs(got[r["i"]][c] - r[c]) < 1e-9 for c in measures.NAMES), texts[r["i"]]


def test_large_vocabularies_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "alpha beta beta it"), (2, None), (3, "gamma"), (3, "gamma")], "doc_id long, text string")
    book = spark.createDataFrame([("alpha", 3.0), ("beta", 1.0)], "word string, weight double")
    sent = sorted(tuple(r) for r in vocabulary.score(df, book).select("doc_id", "pmi_score").collect())
    monkeypatch.setattr(vocabulary, "MAX_WORDS", 1)
    assert sorted(tuple(r) for r in vocabulary.score(df, book).select("doc_id", "pmi_score").collect()) == sent == [(1, 5 / 3), (2, 0.0), (3, 0.0), (3, 0.0)]


def test_stream_with_quarantine(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = [("a", "x", 0), ("b", "y", 0), ("c", "z", 1)], [("d", "x", 1), ("e", "y", 0)]
    schema = "record_id string, text_hash string, label int"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = streams.read_stream(spark, f"{base}/in", spark.createDataFrame(part, schema).schema)
        streams.quarantine(stream, f"{base}/out", f"{base}/state").awaitTermination()
    assert sorted(r["record_id"] for r in streams.kept_so_far(spark, f"{base}/out").collect()) == ["b", "c"]


def test_tokenizer_report(spark):
    rows = spark.createDataFrame([("a", "one two", "0"), ("b", "one two three four five six", "1")], "record_id string, text string, label string")
    found = tokenizer_audit.report(rows, tokenizer_audit.whitespace_tokenizer, "blanks", 6)
    assert found["truncation"] == {"rows": 2, "empty": 0, "truncated": 1, "rate": 0.5} and found["examples"][0]["original_length"] == 4 and found["by_label"]["1"]["max"] == 8
    mask = tokenizer_audit.tokenized(rows, max_length=6).orderBy("record_id").collect()
    assert [r["special_tokens_mask"] for r in mask] == [[1, 0, 0, 1, 1, 1], [1, 0, 0, 0, 0, 1]]
    for bad in (dict(max_length=1), dict(example_limit=0)):
        with pytest.raises(ValueError):
            tokenizer_audit.report(rows, tokenizer_audit.whitespace_tokenizer, "blanks", **bad)
    with pytest.raises(ValueError, match="no rows"):
        tokenizer_audit.report(rows.limit(0), tokenizer_audit.whitespace_tokenizer, "blanks")


def test_a_real_vocabulary_as_tokenizer(spark):
    P, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([("a", "Hello world, it's 2024"), ("b", "")], "record_id string, text string")
    got = {r["record_id"]: r["token_ids"] for r in tokenizer_audit.tokenized(rows, tokenizer_audit.file_tokenizer(path), ends=False).collect()}
    assert got == {"a": library.Tokenizer.from_file(path).encode("Hello world, it's 2024", add_special_tokens=False).ids, "b": [0]}


def test_bad_input_fails(spark, tmp_path):
    lists = spark.createDataFrame([(1, [["a", "b"]]), (2, []), (3, None)], "i int, x array<array<string>>")
    assert [r[0] for r in lists.orderBy("i").select(audit.flat(F.col("x"))).collect()] == [["a", "b"], None, None]
    with pytest.raises(Exception, match="several lists"):
        spark.createDataFrame([(1, [["a"], ["b"]])], "i int, x array<array<string>>").select(audit.flat(F.col("x"))).collect()
    with pytest.raises(ValueError, match="of each label"):
        audit.first_per_label(spark.createDataFrame([(1, 0)], "i int, label int"), 1, "i")
    with pytest.raises(ValueError, match="ids repeat"):
        manifest.kept_in_arrival_order(spark.createDataFrame([("a", "x", 0, 1), ("a", "y", 0, 2)], "record_id string, text_hash string, label int, p int"), "p")
    with pytest.raises(ValueError, match="AI rows"):
        pilot.select_groups(spark.createDataFrame([("g", 2, 2, 0, [("model", "m")])], "group_id string, rows long, human long, ai long, coverage array<struct<kind:string,value:string>>"), 4)
    with pytest.raises(ValueError, match="one shard"):
        writers.write_shards(raw(spark), "unused", 0)
    assert readers.read_vocabulary(spark, f"file://{tmp_path}/none.json").count() == 0


def test_shuffled_order_of_groups(spark):
    groups = spark.createDataFrame([(f"g{k:02d}", 2, 1, 1) for k in range(30)], "group_id string, size long, human long, ai long")
    one, other = ({r["group_id"]: r["split"] for r in splits.assign_splits(groups, seed, order="shuffle").collect()} for seed in (1, 2))
    assert len(one) == 30 and one != other and one == {r["group_id"]: r["split"] for r in splits.assign_splits(groups.repartition(5), 1, order="shuffle").collect()}


def test_length_buckets_and_miss_rates(spark):
    df = spark.createDataFrame([(10,), (128,), (2047,), (9000,)], "n int").select(evaluation.length_bucket(F.col("n")).alias("b"))
    assert [r["b"] for r in df.collect()] == ["<128", "128-255", "1024-2047", ">=2048"]
    none = spark.createDataFrame([], "label int, predicted int, score double")
    assert tuple(evaluation.miss_rates(none).first()) == (0.0, 0.0) and evaluation.average_precision(none).first()[0] == 0.0
