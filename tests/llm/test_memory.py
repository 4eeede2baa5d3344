"""What a worker holds is bounded, and where a batch is cut doesn't change a result."""

import tracemalloc

import numpy as np
import pyarrow as pa

from textloom.llm import bpe_codec, langid, minhash, token_counts, words
from textloom.llm._common import slices, tidy
from textloom.llm.bpe import Source, default_vocabulary


def _texts(n):
    return [f"слово{i} word{i} été ★ some more words of text {i % 7}" * (1 + i % 9) for i in range(n)]


def test_pieces_keep_to_their_bytes_whatever_columns_follow():
    texts = _texts(3000)
    short = pa.array(["x"] * len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), short, short, short], names=list("abcde"))
    longest = max(len(t.encode()) for t in texts) + 100
    pieces = list(slices(batch, 50_000))
    assert max(p.nbytes for p in pieces) <= 50_000 + longest
    assert sum(p.num_rows for p in pieces) == len(texts) and pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))


def test_many_short_texts_take_bounded_memory_for_signatures():
    texts = [f"a{i} b c d e" for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(texts)], names=["doc", "t", "digest"])
    next(minhash._sign(batch.slice(0, 10)))
    tracemalloc.start()
    out = next(minhash._sign(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == len(texts) and peak < 80 << 20


def test_signatures_do_not_depend_on_cuts():
    texts = [*_texts(300), None, "", "one", "★★"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(map(str, range(len(texts))))], names=["doc", "t", "digest"])
    whole = next(minhash._sign(batch)).to_pylist()
    assert whole == [next(minhash._sign(batch.slice(i, 1))).to_pylist()[0] for i in range(len(texts))]


def test_a_long_text_leaves_no_powers_behind():
    data = np.frombuffer(b"word " * (1 << 18), np.uint8)
    one = words.words_of(data, np.array([0, len(data)]))
    assert len(set(one.hash.tolist())) == 1 and one.hash[0] == words.words_of(data[:4], np.array([0, 4])).hash[0]
    assert max(len(p) for p in words._pow) <= 1 << 20


def test_learned_counts_and_predictions_do_not_depend_on_cuts():
    texts = [*_texts(400), "", None, "a", "éa", "xyz"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([("a", "b", "c")[i % 3] for i in range(len(texts))])], names=["t", "l"])
    whole, cut = {}, {}
    langid._count(batch, whole)
    for i in range(len(texts)):
        langid._count(batch.slice(i, 1), cut)
    assert all((whole[k] == cut[k]).all() for k in whole) and whole.keys() == cut.keys()
    table = np.array([whole[k] for k in sorted(whole)], float)
    model = langid.Model(sorted(whole), np.log(table[:, 16:] + 0.1).astype(np.float32), table[:, :16] > 0)
    scores = langid._scores(batch.column(0), model)[3]
    parts = [langid._scores(batch.column(0).slice(i, 1), model)[3] for i in range(len(texts))]
    assert np.allclose(scores, np.concatenate(parts), rtol=1e-5)


def test_other_tasks_let_go_what_the_token_operators_keep():
    source = Source.read(default_vocabulary())
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], names=["__row", "t"])
    list(bpe_codec._digest(batch, source))
    list(token_counts._count(batch, source))
    list(tidy(iter, keep=True)([batch]))
    assert bpe_codec.encoder.cache_info().currsize and token_counts._known
    list(tidy(iter)([batch]))
    assert not bpe_codec.encoder.cache_info().currsize and not bpe_codec.vocabulary.cache_info().currsize and not token_counts._known
