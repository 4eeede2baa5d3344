"""The pipeline's stages on a small table with a planted case for each, and the whole against plain Python."""

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
from test_decontaminate import covered
from tokenizers import Tokenizer

import corpus_pipeline

RNG = np.random.default_rng(21)
EN = "the of and to in that was with for this from are have which".split()
WORDS = ["".join(RNG.choice(list("aeioustrnl"), RNG.integers(3, 8))) for _ in range(800)]


def line(n=14):
    return " ".join(str(RNG.choice(EN)) if k % 3 == 0 else str(RNG.choice(WORDS)) for k in range(n))


def test_stages_and_run_agree(spark, tmp_path):
    items = [line(40) for _ in range(3)]
    texts = ["\n".join(line() for _ in range(4)) for _ in range(30)]
    common = line()
    first, second = line(60).split(), line(60)
    copy = [*first[:30], "changed", *first[31:]]
    texts += [f"{common}\n{line(16)}", f"{common}\n{line(16)}", " ".join(first), " ".join(copy) + "\n" + line(3), f"{line()}\n{items[0]}", "123 456", "", second, second]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None)]
    (tmp_path / "sf").mkdir()
    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(range(30)) <= set(seen["tokens"])
    assert not {35, 36, 500} & set(seen["language"])
    assert seen["lines"][30]["text"].startswith(common) and common not in seen["lines"][31]["text"]
    assert seen["lines"][31]["n_chars"] == len(seen["lines"][31]["text"])
    assert 38 not in seen["lines"] and 34 in seen["near_copies"] and 34 not in seen["benchmark"]
    done = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert done == {k: r["ids_sha256"] for k, r in seen["tokens"].items()}


def plain_words(text):
    return re.findall(r"\w+", (text or "").lower())


def resemble(a, b):
    return sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-9


def without_repeated_lines(docs):
    """Lines that resemble an earlier one go, and with them documents that have nothing else."""
    seen, out = [], {}
    for d in sorted(docs):
        kept, gone = [], 0
        for x in docs[d].split("\n"):
            s = Counter(set(plain_words(x)))
            if s and any(resemble(s, o) for o in seen):
                gone += 1
            else:
                kept.append(x)
            if s:
                seen.append(s)
        text = "\n".join(kept)
        if not gone or text.strip():
            out[d] = text
    return out


def one_of_each_group(docs):
    """The smallest id of each component of documents whose multisets of five-word shingles resemble one another."""
    keys, group = sorted(docs), {}
    bags = {}
    for d in keys:
        w = plain_words(docs[d])
        bags[d] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    for d in keys:
        near = {group[o] for o in group if bags[d] and bags[o] and resemble(bags[d], bags[o])}
        name = min([d, *near])
        group = {o: name if g in near else g for o, g in group.items()} | {d: name}
    return {d: docs[d] for d in keys if group[d] == d}


def test_run_equals_brute_force(spark, tmp_path):
    items = [line(30) for _ in range(4)]
    texts = ["\n".join(line(int(RNG.integers(6, 40))) for _ in range(3)) for _ in range(40)]
    for k in range(30):  # copies with words changed, lines shared, items within, in one piece or in two out of order
        w = line(120).split()
        texts.append(" ".join(w))
        for e in range(int(RNG.integers(1, 4))):
            v = list(w)  # cut into two lines, or the stage lines would take the copy as a whole
            for j in range(e):
                v[11 + 37 * j] = f"changed{k}x{j}"
            cut = int(RNG.integers(30, 90))
            texts.append(" ".join(v[:cut]) + "\n" + " ".join(v[cut:]))
    shared = line(12)
    texts += [f"{line(20)}\n{shared}\n{line(9)}" for _ in range(6)] + ["All rights reserved.", "All rights reserved.\n---\n", shared]
    texts += [f"{line(25)}\n{x}" for x in items] + [" ".join([*items[0].split()[15:], line(8), *items[0].split()[:15]]), line(20) + " " + " ".join(items[1].split()[:10])]
    texts += [None, "", "\n\n", "12 345", "★ € 5", texts[0], texts[1] + "\n"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs = {i: t for i, t, *_ in rows if any(unicodedata.category(c)[0] == "L" for c in t or "")}
    left = without_repeated_lines(docs)
    single = one_of_each_group(left)
    clean = {d: t for d, t in single.items() if not any(n >= 5 and c >= 0.5 for c, n in (covered(t, x) for x in items))}
    assert len(docs) > len(left) > len(single) > len(clean)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = {d: hashlib.sha256(",".join(map(str, encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for d, t in clean.items()}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, line(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
