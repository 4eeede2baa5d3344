"""Exact BPE encoding in linear time by backtracking, and decoding by an offset table.

For a pre-token, one Aho-Corasick pass finds the longest token that starts at every byte. The encoder then walks left to
right: a token is taken if the two last tokens are compatible (the pair, once merged byte by byte, falls apart into just
these two) and the place behind it isn't known as a dead end; else the token's next shorter prefix is tried, and without
one the walk goes back a token and marks the place. Compatibility of a pair is decided from the vocabulary's split table
and kept in a table. Tokens that merging would never form out of their own bytes are no candidates.

Defined cases: a null text encodes as empty (no ids). Rows keep their number and order; special strings of the vocabulary
encode as their one id. Ids outside the vocabulary fail on decoding.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import KEPT, arrow_map
from textloom.llm.bpe import Source, Vocabulary, default_vocabulary, merge_counts, pretokens, texts_of, vocabulary

REMEMBER = 500_000


class Encoder:
    def __init__(self, source: Source):
        import ahocorasick

        v = self.v = vocabulary(source)
        formed = merge_counts(v.symbol, v) == 1
        self.length = [len(s) for s in v.symbol]
        self.at = {s: i for i, s in enumerate(v.symbol) if formed[i]}
        self.alone = {s: int(v.ids[i]) for s, i in self.at.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.at.items():
            self.automaton.add_word(s.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [next((self.at[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.at), -1) for s in v.symbol]
        self.fits: dict[int, bool] = {}
        self.ids = v.ids.tolist()
        # what the process has met: code of a pre-token, and the ids of each code one behind another
        self.code: dict[str, int] = {}
        self.flat, self.ptr = array("i"), array("q", [0])

    def compatible(self, a: int, b: int) -> bool:
        """Would merging the bytes of a and b end with just a and b? Undo merges, the youngest first, along the border."""
        key = a * self.v.size + b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * REMEMBER:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        pair, parts = self.v.pair, self.v.parts
        limit = 1 << 40  # a pair counts if it merges before what was undone last
        while True:
            rank = pair.get((a, b))
            if rank is not None and rank + 256 < limit:
                return False
            if a > b:
                limit, x = a, parts[a][1]
                if x == a:
                    limit, y = b + 1, parts[b][0]
                    if y == b:
                        return True
                    b = y
                else:
                    a = x
            else:
                limit, y = b + 1, parts[b][0]
                if y == b:
                    limit, x = a, parts[a][1]
                    if x == a:
                        return True
                    a = x
                else:
                    b = y

    def encode_word(self, word: bytes) -> list[int]:
        one = self.alone.get(word)
        if one is not None:
            return [one]
        n, length, shorter, compatible = len(word), self.length, self.shorter, self.compatible
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends grow, so the longest comes last
        open_ = bytearray(b"\1") * (n + 1)
        tokens: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            end = pos + length[token]
            if open_[end] and (not tokens or compatible(tokens[-1], token)):
                tokens.append(token)
                pos, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # no token fits here: go back
                open_[pos] = 0
                last = tokens.pop()
                pos -= length[last]
                token = shorter[last]
        return [self.ids[t] for t in tokens]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one behind another, and where each text's begin."""
        if len(self.code) > REMEMBER:
            self.code.clear()
            self.flat, self.ptr = array("i"), array("q", [0])
        lists = [pretokens(t, self.v) for t in texts]
        for w in set(chain.from_iterable(lists)).difference(self.code):
            self.flat.extend([self.v.special[w]] if w in self.v.special else self.encode_word(w.encode()))
            self.code[w] = len(self.ptr) - 1
            self.ptr.append(len(self.flat))
        flat, ptr = np.array(self.flat, np.int64), np.array(self.ptr, np.int64)
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(lists)), np.int64)
        ids = expand(codes, flat, ptr)
        sizes = np.concatenate([[0], np.cumsum(ptr[codes + 1] - ptr[codes])])
        return ids, sizes[np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)]


def expand(codes: np.ndarray, flat: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The slices flat[ptr[c]:ptr[c + 1]] of all codes, one behind another."""
    size = ptr[codes + 1] - ptr[codes]
    first = np.cumsum(size) - size
    return flat[np.repeat(ptr[codes] - first, size) + np.arange(int(size.sum()))]


@lru_cache(maxsize=2)
def encoder(source: Source) -> Encoder:
    return Encoder(source)


KEPT.append(encoder.cache_clear)


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of ids, special strings included; bytes that aren't UTF-8 become U+FFFD."""
    return expand(np.asarray(ids, np.int64), v.blob, v.offset).tobytes().decode("utf-8", "replace")


def _digest(batch: pa.RecordBatch, source: Source) -> Iterator[pa.RecordBatch]:
    e = encoder(source)
    v = e.v
    ids, ptr = e.encode_texts(texts_of(batch.column(1)))
    digits, text = expand(ids, v.digits, v.digits_offset), expand(ids, v.blob, v.offset)
    d_at = np.concatenate([[0], np.cumsum(v.digits_offset[ids + 1] - v.digits_offset[ids])])[ptr]
    t_at = np.concatenate([[0], np.cumsum(v.offset[ids + 1] - v.offset[ids])])[ptr]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    a = [sha(digits[s : max(s, t - 1)].tobytes()) for s, t in zip(d_at[:-1].tolist(), d_at[1:].tolist(), strict=True)]
    b = [sha(text[s:t].tobytes().decode("utf-8", "replace").encode()) for s, t in zip(t_at[:-1].tolist(), t_at[1:].tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ptr)), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["__row", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode(batch: pa.RecordBatch, source: Source) -> Iterator[pa.RecordBatch]:
    ids, ptr = encoder(source).encode_texts(texts_of(batch.column(1)))
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids, pa.int32()))], names=["__row", "ids"])


def _decode(batch: pa.RecordBatch, source: Source) -> Iterator[pa.RecordBatch]:
    v = vocabulary(source)
    texts = [decode(np.array(x or [], np.int64), v) for x in batch.column(1).to_pylist()]
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["__row", "text"])


def _per_row(df: DataFrame, value: str, key: str, fn, kind: str, vocabulary_path: str | None) -> DataFrame:
    source = Source.read(vocabulary_path or default_vocabulary())
    row = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(F.col(key).alias("__row"), F.col(value).alias("__t")), partial(fn, source=source), f"__row {row}, {kind}", 1_000_000, keep=True).withColumnRenamed("__row", key)


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary_path: str | None = None) -> DataFrame:
    """Per row: key, ids (array of int)."""
    return _per_row(docs, text, key, _encode, "ids array<int>", vocabulary_path)


def decode_documents(encoded: DataFrame, ids: str = "ids", key: str = "doc_id", vocabulary_path: str | None = None) -> DataFrame:
    """Per row: key, text."""
    return _per_row(encoded, ids, key, _decode, "text string", vocabulary_path)


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary_path: str | None = None) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256 (digests of the ids and of the text decoded from them)."""
    return _per_row(docs, text, key, _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", vocabulary_path)
