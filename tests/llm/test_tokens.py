"""Token counts and BPE against the tokenizers library, on texts of all kinds."""

import hashlib

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from textloom.llm import bpe_codec, token_counts  # noqa: E402
from textloom.llm.bpe import Source, default_vocabulary  # noqa: E402

TEXTS = [
    None, "", " ", "\n\n  \t", "Hello world, it's 2024!", "naïve Ünïcödé 你好 мир שלום 😀👩‍👩‍👧", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3001, "  lead and trail  ",
    "12345678901234567890 !!!???...", " nbsp em", "tab\tnew\r\nline", "ab" * 500 + "́", "ﬁ ligature ½ ²", "\x00\x01 control", "the the the", "the the the", "日本語テキスト" * 40,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_and_round_trip_equal_the_library(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("n_tokens", F.lit("clash"))
    enc = library.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)
    counts = {r["doc_id"]: r for r in token_counts.token_counts(df).collect()}
    trips = {r["doc_id"]: r for r in bpe_codec.round_trip(df).collect()}
    for i, (t, e) in enumerate(zip(TEXTS, enc)):
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len((t or "").encode()), len(e.ids), len(e.ids) > 512), t
        assert trips[i]["n_tokens"] == len(e.ids), t
        assert trips[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), t
        assert trips[i]["decoded_sha256"] == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest(), t
    ids = bpe_codec.encode_documents(df)
    assert {r["doc_id"]: r["text"] for r in bpe_codec.decode_documents(ids).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(df).count() == 0 and bpe_codec.round_trip(df).count() == 0


def test_backtracking_agrees_with_merging_on_random_bytes(library):
    import numpy as np

    e = bpe_codec.encoder(Source.read(default_vocabulary()))
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 40, 200):
        for letters in ("ab", "the ing", "etaoinshrdlu"):
            w = "".join(rng.choice(list(letters.replace(" ", "")), n))
            assert e.encode_word(w.encode()) == library.encode(w, add_special_tokens=False).ids


def test_long_pretokens_equal_the_library(library):
    import time

    import numpy as np

    from textloom.llm.bpe import merge_counts, vocabulary

    v = vocabulary(Source.read(default_vocabulary()))
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list(letters), n)) for n in (256, 257, 1000, 5000) for letters in ("ab", "theing", "etaoinshrdluöé", "a")]
    words += ["the" * 400, "日本語" * 200, "x", ""]
    got = merge_counts([w.encode() for w in words], v).tolist()
    assert got == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    began = time.process_time()
    long = "".join(rng.choice(list("etaoinshrdluxyz"), 160_000))
    assert merge_counts([long.encode()], v)[0] == len(library.encode(long, add_special_tokens=False).ids)
    assert time.process_time() - began < 10


def test_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(df).collect()) == [(0, 2), (0, 2), (1, 0), (1, 1)]
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe_codec.round_trip(df).collect()) == [(0, 2), (0, 2), (1, 0), (1, 1)]
