"""What byte-level BPE operators share: the vocabulary, its merges and the pre-tokens of a text.

The vocabulary file is read once on the driver from a path given as a parameter and travels with the tasks as its JSON
text (a few MB at most, checked), so executors need no file. Workers build their tables once a process.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from textloom.llm._common import KEPT

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_VOCAB_BYTES = 64 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Source:
    """The vocabulary's JSON; equal sources share one table in a process."""

    text: str = field(repr=False)
    key: str

    @staticmethod
    def read(path: str) -> Source:
        if os.path.getsize(path) > MAX_VOCAB_BYTES:
            raise ValueError(f"{path}: a vocabulary of over {MAX_VOCAB_BYTES} bytes is not sent to tasks")
        with open(path, encoding="utf-8") as f:
            text = f.read()
        return Source(text, hashlib.sha256(text.encode()).hexdigest())

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other) -> bool:
        return isinstance(other, Source) and self.key == other.key


def _alphabet() -> dict[str, int]:
    """Byte-level BPE writes bytes as printable characters: those that print stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Symbols are numbered by age: the 256 bytes, then one for each merge, in the order of merges."""

    def __init__(self, source: Source):
        spec = json.loads(source.text)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not pre.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE vocabulary of the kind that this operator follows")
        back = _alphabet()
        to_bytes = lambda s: bytes(back[c] for c in s)
        ids = {to_bytes(t): i for t, i in model["vocab"].items()}
        at = {bytes([b]): b for b in range(256)}
        self.symbol: list[bytes] = [bytes([b]) for b in range(256)]
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        pairs, news = [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = to_bytes(a), to_bytes(b)
            if a + b not in at:
                at[a + b] = len(self.symbol)
                self.symbol.append(a + b)
                self.parts.append((at[a], at[b]))
            pairs.append((at[a], at[b]))
            news.append(at[a + b])
        self.size = len(self.symbol)
        self.ids = np.array([ids[s] for s in self.symbol], np.int64)
        self.pair = {p: r for r, p in reversed(list(enumerate(pairs)))}
        key = np.array([a * self.size + b for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank, self.pair_new = key[order], order.astype(np.int64), np.array(news, np.int64)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        top = max([*ids.values(), *special.values()]) + 1
        byte_of = [b""] * top
        for t, i in ids.items():
            byte_of[i] = t
        for t, i in special.items():
            byte_of[i] = t.encode()
        #: The offset table of decoding: token i is blob[offset[i]:offset[i + 1]].
        self.blob = np.frombuffer(b"".join(byte_of), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in byte_of])]).astype(np.int64)
        digits = [b"%d," % i for i in range(top)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digits_offset = np.concatenate([[0], np.cumsum([len(b) for b in digits])]).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(source: Source) -> Vocabulary:
    return Vocabulary(source)


KEPT.append(vocabulary.cache_clear)


_find = regex.compile(PATTERN).findall


def pretokens(text: str, v: Vocabulary) -> list[str]:
    """Pre-tokens of a text in order; a special string stands alone."""
    if v.split is None or not any(s in text for s in v.special):
        return _find(text)
    out: list[str] = []
    for k, part in enumerate(v.split.split(text)):
        if k % 2:
            out.append(part)
        elif part:
            out += _find(part)
    return out


LONG = 256  # bytes from which a pre-token is merged by itself


def merge_counts(words: list[bytes], v: Vocabulary) -> np.ndarray:
    """Symbols that are left of each word. Short words advance together; a long one looks again at changed places only."""
    long = [k for k, w in enumerate(words) if len(w) >= LONG]
    if not long:
        return _merge_short(words, v)
    out = np.zeros(len(words), np.int64)
    for k in long:
        out[k] = _merge_long(words[k], v)
    short = [k for k, w in enumerate(words) if len(w) < LONG]
    if short:
        out[short] = _merge_short([words[k] for k in short], v)
    return out


def _ranks(a: np.ndarray, b: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Ranks of the pairs of symbols, -1 for those that don't merge."""
    key = a * v.size + b
    at = np.searchsorted(v.pair_key, key)
    at[at == len(v.pair_key)] = 0
    return np.where(v.pair_key[at] == key, v.pair_rank[at], -1)


def _every_other(place: np.ndarray, touching: np.ndarray) -> np.ndarray:
    """x x x: every other place of a run of touching ones."""
    if not touching.any():
        return place
    start = np.concatenate([[True], ~touching])
    run = np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
    return place[(np.arange(len(place)) - run) % 2 == 0]


def _merge_long(word: bytes, v: Vocabulary) -> int:
    """Symbols that are left of one word: its symbols are chained, and the places of each rank wait under that rank. Each
    round merges all places of the lowest rank at once and ranks the pairs at both sides of them anew."""
    n = len(word)
    sym = np.append(np.frombuffer(word, np.uint8).astype(np.int64), 0)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    rank = np.append(_ranks(sym[: n - 1], sym[1:n], v), [-1, -1])  # of the pair that begins at a place; the end has none
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def put(place: np.ndarray) -> None:
        r = rank[place]
        order = np.argsort(r, kind="stable")
        r, place = r[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else []
        for a, b in zip(first, [*first[1:], len(r)], strict=True):
            if r[a] >= 0:
                k = int(r[a])
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(queue, k)
                waiting[k].append(place[a:b])

    put(np.arange(n - 1))
    left = n
    while queue:
        low = heapq.heappop(queue)
        place = np.unique(np.concatenate(waiting.pop(low)))
        place = place[rank[place] == low]  # pairs that have changed since are gone
        if not len(place):
            continue
        place = _every_other(place, after[place[:-1]] == place[1:])
        gone = after[place]
        sym[place] = v.pair_new[low]
        after[place] = after[gone]
        before[after[place]] = place
        rank[gone] = -1
        left -= len(place)
        side = before[place]
        changed = np.unique(np.concatenate([place, side[side >= 0]]))
        to = after[changed]
        rank[changed] = np.where(to < n, _ranks(sym[changed], sym[to], v), -1)
        put(changed)
    return left


def _merge_short(words: list[bytes], v: Vocabulary) -> np.ndarray:
    count = np.array([len(w) for w in words], np.int64)
    out = count.copy()
    sym = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    seq = np.repeat(np.arange(len(words)), count)
    none = np.int64(1 << 60)
    while len(sym) > 1:
        rank = _ranks(sym[:-1], sym[1:], v)
        rank = np.append(np.where((rank < 0) | (seq[:-1] != seq[1:]), none, rank), none)
        first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        low = np.minimum.reduceat(rank, first)
        live = low < none
        size = np.diff(np.append(first, len(seq)))
        hit = (rank == np.repeat(low, size)) & (rank < none)
        if not hit.any():
            break
        place = np.flatnonzero(hit)
        place = _every_other(place, np.diff(place) == 1)
        sym[place] = v.pair_new[rank[place]]
        keep = np.repeat(live, size)
        keep[place + 1] = False
        out -= np.bincount(seq[place], minlength=len(out))
        sym, seq = sym[keep], seq[keep]
    return out


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]
