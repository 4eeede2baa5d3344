"""A balanced sample of whole groups that covers models, domains and attacks."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.stable import stable_rank
from textloom.operators.ingest import none_if_empty, require, require_rows
from textloom.session import materialise

COLUMNS = {"record_id", "group_id", "label", "split", "model", "domain", "attack"}


def _kinds():
    """(kind, value) pairs of a row; an absent attack is ``none``, other gaps ``unknown``."""
    gap = {"model": "unknown", "domain": "unknown", "attack": "none"}
    return [F.struct(F.lit(k).alias("kind"), F.coalesce(none_if_empty(F.col(k)), F.lit(v)).alias("value")) for k, v in gap.items()]


def check_assignments(rows: DataFrame, split: str) -> None:
    require(rows, COLUMNS)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    require_rows(rows, blank("record_id") | blank("group_id") | ~F.col("split").eqNullSafe(split) | ~F.coalesce(F.col("label").cast("string").isin("0", "1"), F.lit(False)), "bad assignment rows")


def summarize(rows: DataFrame) -> DataFrame:
    """(group_id, rows, human, ai, coverage)."""
    one = rows.select("group_id", F.col("label").cast("string").alias("label"), F.array(*_kinds()).alias("cover"))
    return one.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == "0").alias("human"),
        F.count_if(F.col("label") == "1").alias("ai"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("cover")))).alias("coverage"),
    )


def target_human(total: int, human: int, target_rows: int, fraction: float, ai: int | None = None) -> int:
    if target_rows < 2 or not 0 < fraction < 1:
        raise ValueError("target_rows must be 2 at least and the fraction between 0 and 1")
    want = min(round(min(target_rows, total) * fraction), human)
    if want < 1:
        raise ValueError("no human rows to select")
    if ai is not None and ai < 1:
        raise ValueError("no AI rows to select")
    return want


def select_groups(summaries: DataFrame, target_rows: int = 10_000, fraction: float = 0.5) -> DataFrame:
    """(group_id) of the groups taken until their human rows reach the target.

    Each step takes the group of the least cost (distance from the target, excess, new coverage), ties by id. Groups
    of equal human rows and coverage differ in their id only. A group that covers something new can only be the first of
    its class, as after it the class covers nothing new; any other one is the first left of all groups with as many human
    rows, as a group of these that covers something new would cost less. So the driver sees the first of each class, and,
    of each number of human rows, as many of the first ids as there can be steps.
    """
    t = summaries.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("human"), F.lit(0)).alias("h"), F.coalesce(F.sum("ai"), F.lit(0)).alias("a")).first()
    goal = target_human(t["n"], t["h"], target_rows, fraction, t["a"])
    # Most groups may be alike: the first ids of each of 64 parts, then the first of those.
    most = F.ceil(F.lit(goal) / F.col("human"))
    part = Window.partitionBy("human", F.pmod(F.xxhash64("group_id"), F.lit(64))).orderBy("group_id")
    some = summaries.where("human > 0").select("group_id", "human", "coverage")
    early = some.withColumn("k", F.row_number().over(part)).where(F.col("k") <= most)
    early = early.withColumn("k", F.row_number().over(Window.partitionBy("human").orderBy("group_id"))).where(F.col("k") <= most).drop("k")
    heads = some.groupBy("human", "coverage").agg(F.min("group_id").alias("group_id")).select("group_id", "human", "coverage")
    classes: dict[tuple, list[str]] = {}
    for r in early.union(heads).distinct().collect():
        classes.setdefault((r["human"], frozenset((c["kind"], c["value"]) for c in r["coverage"])), []).append(r["group_id"])
    queues = {k: sorted(v, reverse=True) for k, v in classes.items()}
    covered: set = set()
    taken, have = [], 0
    alike = None  # per human rows and number of new kinds, a heap of classes by their first id
    while have < goal:
        if alike is None:
            alike = {}
            for at, ((h, cover), ids) in enumerate(queues.items()):
                if ids:
                    alike.setdefault((h, len(cover - covered)), []).append((ids[-1], at, (h, cover)))
            for heap in alike.values():
                heapq.heapify(heap)
        best = None
        for (h, new), heap in alike.items():
            total = have + h
            cost = abs(total - goal) / max(goal, 1) + 3 * max(0, total - goal) / max(goal, 1) - 0.03 * new
            if best is None or (cost, heap[0][0]) < best[:2]:
                best = (cost, heap[0][0], h, new)
        if best is None:
            raise ValueError("the groups don't hold enough human rows")
        heap = alike[best[2:]]
        group, at, key = heapq.heappop(heap)
        queues[key].pop()
        if queues[key]:
            heapq.heappush(heap, (queues[key][-1], at, key))
        elif not heap:
            del alike[best[2:]]
        taken.append(group)
        have += key[0]
        if key[1] - covered:
            covered |= key[1]
            alike = None
    return summaries.sparkSession.createDataFrame([(g,) for g in taken], "group_id string")


def summary(rows: DataFrame, selected: DataFrame, pilot_rows: DataFrame) -> dict:
    """Counts of the source, the selected groups and the sample, for a report."""
    one = lambda df: df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label").cast("string") == "0").alias("human"), F.count_if(F.col("label").cast("string") == "1").alias("ai"), F.count_distinct("group_id").alias("groups")).first().asDict()
    by = lambda c: {r[c]: r["n"] for r in pilot_rows.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c)).agg(F.count(F.lit(1)).alias("n")).orderBy(c).toLocalIterator()}
    return {"source": one(rows), "selected_groups": selected.count(), "pilot": one(pilot_rows), "counts": {c: by(c) for c in ("model", "domain", "attack")}}


def overlap(selected: DataFrame, others: DataFrame) -> DataFrame:
    """(split, shared): selected groups that occur in another split; both other splits appear."""
    spark = selected.sparkSession
    names = spark.createDataFrame([("validation",), ("test",)], "split string")
    shared = others.select("split", "group_id").distinct().join(selected.select("group_id").distinct(), "group_id", "left_semi").groupBy("split").agg(F.count(F.lit(1)).alias("shared"))
    return F.broadcast(names).join(shared, "split", "left").select("split", F.coalesce("shared", F.lit(0)).alias("shared"))


def sample_rows(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """``limit`` rows that cover models, domains and attacks first, then go by stable rank.

    In the cover phase only the first row of each (model, domain, attack) can ever be chosen, so the driver sees those.
    """
    ranked = rows.withColumn("__r", stable_rank(F.col("record_id"), seed))
    if limit < 1:
        return rows.limit(0)
    heads = ranked.select(F.array(*_kinds()).alias("cover"), "__r", "record_id").groupBy("cover").agg(F.min(F.struct("__r", "record_id")).alias("first")).collect()
    open_ = {r["first"]["__r"]: (r["first"]["record_id"], {(c["kind"], c["value"]) for c in r["cover"]}) for r in heads}
    missing = set().union(*(c for _, c in open_.values())) if open_ else set()
    taken: list[str] = []
    while missing and len(taken) < limit:
        rank = min(open_, key=lambda r: (-len(open_[r][1] & missing), r))
        record, cover = open_.pop(rank)
        taken.append(record)
        missing -= cover
    first = rows.sparkSession.createDataFrame([(t, 0) for t in taken], "record_id string, __o int")
    order = ranked.join(F.broadcast(first), "record_id", "left")
    return order.orderBy(F.coalesce("__o", F.lit(1)), "__r").limit(limit).select(*rows.columns)


def balanced(rows: DataFrame, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """All human rows of the selected groups and as many AI rows as the fraction asks for, with their final order."""
    rows = materialise(rows, "pilot-rows")
    human = rows.where(F.col("label").cast("string") == "0")
    n = human.count()
    want = round(n * (1 - fraction) / fraction)
    ai = sample_rows(rows.where(F.col("label").cast("string") == "1"), want, seed + 1)
    ai = materialise(ai, "pilot-ai")
    got = ai.count()
    if got != want:
        raise ValueError(f"{want} AI rows are needed, {got} found")
    return sample_rows(human, n, seed).unionByName(ai).withColumn("pilot_rank", stable_rank(F.col("record_id"), seed + 2))
