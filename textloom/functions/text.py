"""Text functions, Column to Column, on the JVM: words, sentences, diversity measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a maximal run of letters, digits and underscores made of ASCII letters only.
_WORD = r"(?<![\p{L}\p{N}_])[a-z]{%d,}+(?![\p{L}\p{N}_])"


def words(text: Column, least: int = 1) -> Column:
    """Lower-case ASCII words of at least ``least`` letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD % least), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space (as Unicode has it) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def sentence_sizes(text: Column) -> Column:
    """Words of each sentence that has any; sentences end with stops followed by white space or the text's end."""
    sizes = F.transform(F.split(text, r"(?U)[.!?]+(?:\s+|$)", -1), lambda s: F.size(words(s)).cast("long"))
    return F.filter(sizes, lambda n: n > 0)


def burstiness(text: Column) -> Column:
    """Population deviation of sentence sizes over their mean; 0 for fewer than two sentences."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    total = F.aggregate(sentence_sizes(text), zero, lambda a, x: F.struct((a.n + 1).alias("n"), (a.s + x).alias("s"), (a.q + x * x).alias("q")), lambda a: F.when(a.n < 2, 0.0).otherwise(F.sqrt((a.n * a.q - a.s * a.s).cast("double")) / F.greatest(a.s, F.lit(1))))
    return F.coalesce(total, F.lit(0.0))


def word_stats(text: Column) -> Column:
    """struct(n, distinct, clogc): words, different words, and the sum of c*log2(c) over the words' counts."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("d"), F.lit(0.0).alias("t"))
    term = lambda c: F.when(c > 1, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(0.0)

    def step(a: Column, x: Column) -> Column:
        same = a.w == x
        return F.struct(x.alias("w"), (a.n + 1).alias("n"), F.when(same, a.c + 1).otherwise(1).cast("long").alias("c"), F.when(same, a.d).otherwise(a.d + 1).cast("long").alias("d"), F.when(same, a.t).otherwise(a.t + term(a.c)).alias("t"))

    return F.aggregate(F.array_sort(words(F.coalesce(text, F.lit("")))), start, step, lambda a: F.struct(a.n.alias("n"), a.d.alias("distinct"), (a.t + term(a.c)).alias("clogc")))


def rttr(stats: Column) -> Column:
    """Different words over the root of all words; 0 without words."""
    return F.when(stats.n == 0, 0.0).otherwise(stats.distinct / F.sqrt(F.greatest(stats.n, F.lit(1)).cast("double")))


def entropy(stats: Column) -> Column:
    """Shannon entropy of the words, in bits; 0 without words."""
    n = F.greatest(stats.n, F.lit(1)).cast("double")
    return F.when(stats.n == 0, 0.0).otherwise(F.greatest(F.log2(n) - stats.clogc / n, F.lit(0.0)))


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)
