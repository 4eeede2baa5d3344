"""The text measures of ``text.py`` for batches of texts: one pass over the words of each text, in Arrow batches.

Words, sentences and measures are those of the column functions; a test holds both against each other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa

BATCH_BYTES = 8 << 20
NAMES = ("burstiness", "rttr", "entropy")
_RUN = re.compile(r"\w+")
#: White space as Unicode has it, for which Python's own class also takes four control characters.
_STOP = re.compile("[.!?]+(?:[\t-\r \u0085   -     　]+|$)")


def words(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores that are made of ASCII letters only."""
    return [w for w in _RUN.findall(text.lower()) if w.isascii() and w.isalpha()]


def measure(text: str) -> tuple[float, float, float, list[str]]:
    """(burstiness, rttr, entropy, words) of a text."""
    found: list[str] = []
    n = q = 0
    for sentence in _STOP.split(text):
        w = words(sentence)
        if w:
            found += w
            n += 1
            q += len(w) * len(w)
    total = len(found)
    if not total:
        return 0.0, 0.0, 0.0, found
    burst = 0.0 if n < 2 else math.sqrt(n * q - total * total) / total
    counts = Counter(found)
    clogc = sum(c * math.log2(c) for c in counts.values() if c > 1)
    return burst, len(counts) / math.sqrt(total), max(math.log2(total) - clogc / total, 0.0), found


def append(batches: Iterator[pa.RecordBatch], at: int, weights: Mapping[str, float] | None, measures: bool) -> Iterator[pa.RecordBatch]:
    """The batches with the mean weight of the words of three letters at least (if ``weights`` are given) and the measures
    of the text in column ``at``."""
    get = weights.get if weights is not None else None
    for b in batches:
        cols: list[list[float]] = [[] for _ in range((get is not None) + 3 * measures)]
        for text in b.column(at).to_pylist():
            if measures:
                *values, found = measure(text or "")
            else:
                values, found = [], words(text or "")
            if get is not None:
                long = [w for w in found if len(w) >= 3]
                values = [sum([get(w, 0.0) for w in long]) / len(long) if long else 0.0, *values]
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        names = ["pmi_score"] * (get is not None) + list(NAMES) * measures
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.float64()) for c in cols]], names=[*b.schema.names, *names])
