"""Metrics of a classifier's scores, in relational form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_class(predicted: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) of classes 0 and 1, and accuracy in each row."""
    cells = predicted.groupBy(F.col("label").cast("int").alias("y"), F.col("predicted").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))), F.lit(0)).alias("right"))
    rows = cells.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "y", "p", "n").groupBy("class").agg(
        *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("hit", (F.col("y") == F.col("class")) & (F.col("p") == F.col("class"))), ("said", F.col("p") == F.col("class")), ("support", F.col("y") == F.col("class")))]
    )
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.greatest(b, F.lit(1)))
    rows = rows.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    rows = rows.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))))
    out = rows.join(F.broadcast(total))  # one row
    return out.select("class", *[F.round(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")], "support", F.round(ratio(F.col("right"), F.col("all")), 6).alias("accuracy"))


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct score; what follows works on these."""
    return scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def roc_auc(scored: DataFrame, buckets: int = 1024) -> DataFrame:
    """(auc): area under the ROC curve, ties counted half. Prefix sums run in two steps, buckets of scores and within, so
    no task sorts all scores."""
    steps = _by_score(scored).withColumn("b", F.floor(F.col("score") * buckets))
    per = steps.groupBy("b").agg(F.sum("neg").alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "before")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = steps.withColumn("in", inside).join(before, "b").agg(F.sum(F.col("pos") * (F.col("before") + F.col("in") + F.col("neg") / 2)).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return wins.select(F.round(F.when((F.col("p") == 0) | (F.col("n") == 0), 0.0).otherwise(F.col("w") / F.greatest(F.col("p") * F.col("n"), F.lit(1))), 6).alias("auc"))


def _running(scored: DataFrame, buckets: int = 1024) -> DataFrame:
    """Each distinct score with tp and fp, the positives and negatives of that score and above, and pos, neg, P, N. Sums run
    in two steps, buckets of scores and within, so no task sorts all scores."""
    steps = _by_score(scored).withColumn("b", F.floor(F.col("score") * buckets))
    per = steps.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    above = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = per.select("b", zero(F.sum("bp").over(above)).alias("ap"), zero(F.sum("bn").over(above)).alias("an"))
    total = scored.agg(F.count_if(F.col("label") == 1).alias("P"), F.count_if(F.col("label") == 0).alias("N"))
    w = Window.partitionBy("b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = steps.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)}).join(per, "b").join(F.broadcast(total))  # one row
    return out.select("score", "pos", "neg", (F.col("tp") + F.col("ap")).alias("tp"), (F.col("fp") + F.col("an")).alias("fp"), "P", "N")


def threshold_under_fpr(scored: DataFrame, max_fpr: float = 0.05) -> DataFrame:
    """(threshold, tpr, fpr): the lowest score whose false positive rate stays within ``max_fpr``."""
    ok = _running(scored).withColumns({"tpr": F.col("tp") / F.greatest("P", F.lit(1)), "fpr": F.col("fp") / F.greatest("N", F.lit(1))}).where(F.col("fpr") <= max_fpr)
    best = ok.agg(F.min_by(F.struct("score", "tpr", "fpr"), "score").alias("x"))
    return best.select(F.round("x.score", 6).alias("threshold"), F.round("x.tpr", 6).alias("tpr"), F.round("x.fpr", 6).alias("fpr"))


def average_precision(scored: DataFrame) -> DataFrame:
    """(pr_auc): the area under precision and recall, as the sum of precision over the steps of recall; 0 without positives."""
    step = F.col("pos") / F.greatest("P", F.lit(1)) * F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    return _running(scored).agg(F.round(F.coalesce(F.sum(step), F.lit(0.0)), 6).alias("pr_auc"))


def miss_rates(predicted: DataFrame) -> DataFrame:
    """(fpr, fnr): the shares of class 0 called 1 and of class 1 called 0; 0 for a class without rows."""
    y, p = F.col("label"), F.col("predicted")
    share = lambda a, b: F.round(F.count_if(a) / F.greatest(F.count_if(b), F.lit(1)), 6)
    return predicted.agg(share((y == 0) & (p == 1), y == 0).alias("fpr"), share((y == 1) & (p == 0), y == 1).alias("fnr"))


def length_bucket(length, edges: tuple[int, ...] = (128, 256, 512, 1024, 2048)):
    """The name of a length's bucket: ``<128``, ``128-255``, ..., ``>=2048``."""
    out = F.lit(f">={edges[-1]}")
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(length < edges[k], f"<{edges[0]}" if k == 0 else f"{edges[k - 1]}-{edges[k] - 1}").otherwise(out)
    return out


def slices(predicted: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(dimension, value, rows, accuracy), all dimensions in one pass."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("missing")).alias("value")) for d in dims])
    one = predicted.select((F.col("label") == F.col("predicted")).cast("int").alias("ok"), F.explode(cells).alias("c"))
    return one.groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("ok"), 6).alias("accuracy"))


def chunks(rows: DataFrame, size: int, step: int, tokens: str = "tokens") -> DataFrame:
    """Windows of ``size`` tokens every ``step``: the columns, chunk (from 0) and chunk_tokens; the last one may be short."""
    n = F.size(tokens)
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    return rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).withColumn("chunk_tokens", F.slice(F.col(tokens), F.col("chunk") * step + 1, F.lit(size)))


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, weight): rows over classes times the class's rows."""
    c = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return c.join(F.broadcast(total)).select("label", F.round(F.col("t") / (F.col("k") * F.col("n")), 6).alias("weight"))


def route(scored: DataFrame, low: float, high: float) -> DataFrame:
    """``scored`` with route: ``fast`` where the score is sure, else ``slow``."""
    return scored.withColumn("route", F.when((F.col("score") <= low) | (F.col("score") >= high), "fast").otherwise("slow"))
