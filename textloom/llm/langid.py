"""Language identification of whole texts, also of texts that mix languages.

Learning counts byte 4-grams (three bytes and the place's predecessor) of the words of every labelled text by language,
in 2**16 hashed bins: a table of fixed size, gathered with one aggregation. Prediction scores each word under each
language by the mean log-probability of its grams times a bounded word length, lets only languages take part whose
learned scripts cover the word's script, and labels the words by Viterbi with a penalty for switching languages. Texts of
a batch advance in lock-step, one word a step, so the recursion runs in numpy for all of them at once.

Defined cases: a null text, or one without a letter, gets ``und`` with score 0. Null languages and empty training sets
teach nothing (all predictions are ``und`` if no language is learned). Ties go to the alphabetically first language.
Extra columns stay where the frame form is used; the result columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import arrow_map, held_out, ship, slices, tidy
from textloom.llm.words import text_bytes, words_of

BINS = 1 << 16
SCRIPTS = ("latin", "cyrillic", "greek", "hebrew", "arabic", "indic", "thai", "hangul", "kana", "han", "other")
#: Script of the code point ranges, by first code point.
_FROM = ((0x41, 0), (0x370, 2), (0x400, 1), (0x530, 10), (0x590, 3), (0x600, 4), (0x780, 10), (0x900, 5), (0xE00, 6), (0xE80, 10), (0x1100, 7), (0x1200, 10), (0x1E00, 0), (0x1F00, 2), (0x2000, 10), (0x2C60, 0), (0x2C80, 10), (0x3040, 8), (0x3100, 10), (0x3400, 9), (0xA000, 10), (0xAC00, 7), (0xD7B0, 10), (0xF900, 9), (0xFB00, 10))
_STARTS = np.array([a for a, _ in _FROM])
_KIND = np.array([b for _, b in _FROM], np.int8)
_LETTER = np.array([chr(c).isalpha() for c in range(0x34000)])  # no letter lies beyond


_MUL = np.array([0x01000193, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def _grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The hashed bin of the four bytes that end at each byte; separators all count as a blank. A text's first
    bytes have fewer before them, whatever text comes before it, so its grams are the same wherever a batch is cut."""
    x = data.astype(np.uint32)
    a = x * _MUL[0]
    for k in (1, 2, 3):
        a[k:] ^= x[:-k] * _MUL[k]
    for k in range(3):  # the first bytes of a text
        at = off[:-1][np.diff(off) > k] + k
        a[at] = x[at] * _MUL[0]
        for j in range(1, k + 1):
            a[at] ^= x[at - j] * _MUL[j]
    a *= np.uint32(0x27D4EB2F)
    return (a >> np.uint32(16)).astype(np.int64)


def _script(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Script of each word, by its first letter's code point; -1 for a word without a letter (digits, underscores, signs)."""
    out = np.zeros(len(start), np.int8)
    b0 = data[start]
    wide = np.flatnonzero(b0 >= 0xC3)
    if len(wide):
        s = start[wide]
        pad = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
        b, c, d = pad[s], pad[s + 1] & 63, pad[s + 2] & 63
        code = np.where(b < 0xE0, (b & 31) << 6 | c, np.where(b < 0xF0, (b & 15) << 12 | c << 6 | d, 0x1FFFF))
        code = np.where(code < 0x41, 0x41, code)
        out[wide] = np.where(code == 0x1FFFF, 10, _KIND[np.searchsorted(_STARTS, code, "right") - 1])
    letter = (data >= 0x41) & (data < 0x80) & (data != 0x5F)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        b, c, d, e = (np.concatenate([data, np.zeros(4, np.uint8)])[lead + k].astype(np.int64) & (63 if k else 255) for k in range(4))
        code = np.where(b < 0xE0, (b & 31) << 6 | c, np.where(b < 0xF0, (b & 15) << 12 | c << 6 | d, (b & 7) << 18 | c << 12 | d << 6 | e))
        letter[lead] = _LETTER[np.minimum(code, len(_LETTER) - 1)]
    run = np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])
    out[run[end] == run[start]] = -1
    return out


def _scan(column: pa.Array):
    data, off = text_bytes(column)
    w = words_of(data, off)
    return w, _script(data, w.start, w.end), _grams(np.where(w.inside, data, np.uint8(32)), off)


def _count(batch: pa.RecordBatch, total: dict[str, np.ndarray]) -> None:
    """Add the batch's counts: 16 places for scripts, then the bins."""
    langs = pc.dictionary_encode(batch.column(1))
    names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy().astype(np.int64)
    w, script, bins = _scan(batch.column(0))
    bins += np.repeat(code * BINS, np.diff(_bounds(batch.column(0), w)))
    counts = np.bincount(bins[w.inside], minlength=len(names) * BINS).reshape(len(names), BINS)
    known = script >= 0
    scripts = np.bincount((code[w.unit()] * 16 + script)[known], minlength=len(names) * 16).reshape(len(names), 16)
    for k, name in enumerate(names):
        a = total.setdefault(name, np.zeros(BINS + 16, np.int64))
        a[:16] += scripts[k]
        a[16:] += counts[k]


def _bounds(column: pa.Array, w) -> np.ndarray:
    return text_bytes(column)[1] if len(w.data) else np.zeros(len(column) + 1, np.int64)


class Model:
    """Languages in alphabetical order, log-probabilities (languages x bins) and which scripts each language uses."""

    def __init__(self, langs: list[str], logp: np.ndarray, scripts: np.ndarray):
        self.langs, self.logp, self.scripts = langs, logp, scripts


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count over all rows with a language. What reaches the driver is bounded by languages times (BINS + 16) rows."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))

    def part(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in slices(batch):
                _count(piece, total)
        for name, a in total.items():
            i = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(a[i], pa.int64())], names=["lang", "bin", "n"])

    ship(docs.sparkSession)
    got = rows.mapInArrow(tidy(part), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    at = {x: k for k, x in enumerate(langs)}
    table = np.zeros((len(langs), BINS + 16))
    if langs:
        table[[at[x] for x in got.column("lang").to_pylist()], got.column("bin").to_numpy()] = got.column("n").to_numpy()
    scripts = table[:, :16] > 0.001 * np.maximum(table[:, :16].sum(1, keepdims=True), 1)
    logp = np.log((table[:, 16:] + 0.1) / (table[:, 16:].sum(1, keepdims=True) + 0.1 * BINS))
    return Model(langs, logp.astype(np.float32), scripts)


def viterbi(score: np.ndarray, ptr: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of each word, for all units at once: units advance in lock-step, the longest first."""
    length = np.diff(ptr)
    order = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    n_at = np.searchsorted(-length[order], -np.arange(longest), "left")  # units with more than t words
    base, states = ptr[:-1][order], score.shape[1]
    back = np.zeros(score.shape, np.uint8 if states < 255 else np.int32)
    v = np.zeros((len(order), states), np.float64)
    stay = np.arange(states, dtype=back.dtype)
    for t in range(longest):
        m = n_at[t]
        x = v[:m]
        if t:
            b = x.argmax(1)
            jump = x[np.arange(m), b][:, None] - penalty
            move = jump > x
            back[base[:m] + t] = np.where(move, b[:, None].astype(back.dtype), stay)
            x = np.where(move, jump, x)
        v[:m] = x + score[base[:m] + t]
    state = v.argmax(1)
    out = np.zeros(len(score), np.int32)
    for t in range(longest - 1, -1, -1):
        m = n_at[t]
        out[base[:m] + t] = state[:m]
        if t:
            state[:m] = back[base[:m] + t, state[:m]]
    return out


def _constant(s: np.ndarray, ptr: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Units whose best path is proved to stay in one state, and that state.

    Leaving the best single state for a run of words gains at most the sum, over the run, of what the best other state
    has more, and costs one penalty at least. Where no run gains more than the penalty, staying is best.
    """
    n = len(ptr) - 1
    run = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s, axis=0, dtype=np.float64)])
    best = (run[ptr[1:]] - run[ptr[:-1]]).argmax(1)
    unit = np.repeat(np.arange(n), np.diff(ptr))
    at = np.arange(len(s))
    own = s[at, best[unit]]
    rest = s.copy()
    rest[at, best[unit]] = -np.inf
    gain = np.cumsum(rest.max(1).astype(np.float64) - own)
    before = np.concatenate([[0.0], gain[:-1]])
    low = np.minimum.accumulate(before - unit * 1e7) + unit * 1e7  # the lowest sum so far within the unit
    top = np.full(n, -np.inf)
    np.maximum.at(top, unit, gain - low)
    return top < penalty - 0.01, best


def _scores(column: pa.Array, model: Model):
    w, script, bins = _scan(column)
    size = w.end - w.start
    known = np.flatnonzero(script >= 0)
    edges = np.empty(2 * len(size), np.int64)
    edges[::2], edges[1::2] = w.start, np.minimum(w.end, max(0, len(w.data) - 1))
    s = np.empty((len(known), len(model.langs)), np.float32)
    for k in range(len(model.langs) if len(known) else 0):
        x = np.take(model.logp[k], bins)
        tail = x[-1] if len(size) and w.end[-1] == len(x) and size[-1] > 1 else 0  # reduceat can't name the end
        sums = np.add.reduceat(x, edges)[::2]
        if tail:
            sums[-1] += tail
        s[:, k] = sums[known]
    s *= (np.minimum(size, 12) / np.maximum(size, 1))[known, None].astype(np.float32)
    if len(known) and not model.scripts[:, script[known]].all():
        allowed = model.scripts[:, script[known]].T
        narrow = allowed.any(1)
        s[narrow] = np.where(allowed[narrow], s[narrow], s[narrow].min(1, keepdims=True) - 20)
    return w, known, np.searchsorted(w.unit()[known], np.arange(len(w.ptr))), s, size[known]


def label_words(column: pa.Array, model: Model, penalty: float):
    """Of the words with a letter: the start, end, weight in bytes and label of each, and where each unit's begin."""
    parts, hard, at = [], [], 0
    for piece in slices(pa.RecordBatch.from_arrays([column], names=["t"])):
        w, known, ptr, s, size = _scores(piece.column(0), model)
        label = np.zeros(len(known), np.int64)
        if len(known) and len(model.langs) > 1:
            stays, best = _constant(s, ptr, penalty)
            label = np.repeat(best, np.diff(ptr))
            move = np.flatnonzero(~stays & (np.diff(ptr) > 0))
            hard += [(at + ptr[k], s[ptr[k] : ptr[k + 1]].copy()) for k in move]
        parts.append((w.start[known], w.end[known], size, label, np.diff(ptr)))
        at += len(known)
    start, end, size, label, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
    if hard:
        ptr = np.concatenate([[0], np.cumsum([len(s) for _, s in hard])])
        got = viterbi(np.concatenate([s for _, s in hard]), ptr, penalty)
        for k, (a, s) in enumerate(hard):
            label[a : a + len(s)] = got[ptr[k] : ptr[k + 1]]
    return start, end, size, label, np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def spans(text: str, model: Model, penalty: float = 12.0) -> list[tuple[int, int, str]]:
    """(first byte, end byte, language) of the runs of words of one language in the lower-cased text."""
    start, end, _, label, _ = label_words(pa.array([text], pa.string()), model, penalty)
    out: list[tuple[int, int, str]] = []
    for a, b, k in zip(start.tolist(), end.tolist(), label.tolist(), strict=True) if model.langs else ():
        name = model.langs[k]
        out = [*out[:-1], (out[-1][0], b, name)] if out and out[-1][2] == name else [*out, (a, b, name)]
    return out


def _predict(batch: pa.RecordBatch, model: Model, penalty: float) -> Iterator[pa.RecordBatch]:
    n, L = batch.num_rows, max(1, len(model.langs))
    if model.langs:
        _, _, size, label, ptr = label_words(batch.column(1), model, penalty)
        mass = np.bincount(np.repeat(np.arange(n), np.diff(ptr)) * L + label, weights=size, minlength=n * L).reshape(n, L)
    else:
        mass = np.zeros((n, L))
    total = mass.sum(1)
    names = np.array([*model.langs, "und"], object)
    out = np.where(total > 0, mass.argmax(1), len(model.langs))
    share = mass.max(1) / np.maximum(total, 1)
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[out], pa.string()), pa.array(share, pa.float64()), pa.array((mass > 0).sum(1), pa.int32())], names=["__row", "lang_pred", "score", "n_langs"])


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", penalty: float = 12.0) -> DataFrame:
    """Per row: key, lang_pred, score (the share of the letters' bytes that the language labels), n_langs."""
    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("__row"), F.col(text).cast("string").alias("__t")), partial(_predict, model=model, penalty=penalty), f"__row {kind}, lang_pred string, score double, n_langs int", 24_000_000).withColumnRenamed("__row", key)


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.4, penalty: float = 12.0) -> DataFrame:
    """The rows whose language is told with a share of ``min_score`` at least; all columns stay, as they came."""
    names = docs.columns
    fields = [docs.schema[c] for c in names]
    at = names.index("text")

    def pick(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = next(_predict(pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["r", "t"]), model, penalty))
        ok = (got.column(1).to_numpy(zero_copy_only=False) != "und") & (got.column(2).to_numpy() >= min_score)
        yield batch.filter(pa.array(ok))

    from pyspark.sql.types import StructType

    return arrow_map(docs, pick, StructType(fields), 24_000_000)
