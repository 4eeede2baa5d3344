"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch that the process hasn't met lie in one numpy array; every round looks up the rank of
every adjacent pair, takes each sequence's lowest, merges all its places at once and drops sequences without a pair left.
Counts of short pre-tokens are remembered in a table of bounded size, which changes the cost and not the result.

Defined cases: a null text counts as empty (0 bytes, 0 tokens). Rows keep their order and number; repeated rows repeat.
Special strings of the vocabulary count as one token, as the library's defaults have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import KEPT, arrow_map
from textloom.llm.bpe import Source, default_vocabulary, merge_counts, pretokens, texts_of, vocabulary

REMEMBER = 500_000
_known: dict[str, dict[str, int]] = {}
KEPT.append(_known.clear)


def count_texts(texts: list[str], source: Source) -> list[int]:
    v = vocabulary(source)
    known = _known.setdefault(source.key, {})
    if len(known) > REMEMBER:
        known.clear()
    lists = [pretokens(t, v) for t in texts]
    new = [w for w in set(chain.from_iterable(lists)).difference(known) if w not in v.special]
    size = dict(zip(new, merge_counts([w.encode() for w in new], v).tolist(), strict=True)) if new else {}
    long = {w: n for w, n in size.items() if len(w) > 48}
    known.update((w, n) for w, n in size.items() if len(w) <= 48)
    known.update((s, 1) for s in v.special)
    if not long:
        return [sum(map(known.__getitem__, x)) for x in lists]
    return [sum(known[w] if w in known else long[w] for w in x) for x in lists]


def _count(batch: pa.RecordBatch, source: Source) -> Iterator[pa.RecordBatch]:
    texts = texts_of(batch.column(1))
    n = np.array(count_texts(texts, source), np.int64)
    size = np.array([len(t.encode()) for t in texts], np.int64)
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n)], names=["__row", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary_path: str | None = None, limit: int = 512) -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    source = Source.read(vocabulary_path or default_vocabulary())
    kind = docs.schema[key].dataType.simpleString()
    out = arrow_map(docs.select(F.col(key).alias("__row"), F.col(text).cast("string").alias("__t")), partial(_count, source=source), f"__row {kind}, n_bytes long, n_tokens long", 1_000_000, keep=True)
    return out.select(F.col("__row").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
