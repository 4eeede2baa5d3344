"""Greedy assignment of whole groups to splits.

Every step's cost depends on the sums so far, so the steps run one after another; but a step needs nine numbers only. The
three opening groups come from one aggregation each. The others stream in order through one task that holds those
numbers, so no group list is gathered anywhere.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.stable import stable_rank
from textloom.session import materialise, ship_package

ORDER = ("train", "validation", "test")
#: Groups whose ids the driver shuffles at most.
MAX_SHUFFLED = 1_000_000
RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def check_ratios(ratios: dict[str, float]) -> None:
    if set(ratios) != set(ORDER):
        raise ValueError(f"ratios must name {ORDER}")
    if abs(sum(ratios.values()) - 1) > 1e-8:
        raise ValueError("ratios must sum to 1")


class Sums:
    """Rows, human and AI rows of each split, and what they should be."""

    def __init__(self, total: tuple[int, int, int], ratios: dict[str, float], state: dict[str, list[int]] | None = None):
        self.target = {s: [x * ratios[s] for x in total] for s in ORDER}
        self.state = state or {s: [0, 0, 0] for s in ORDER}

    def cost(self, split: str, group: tuple[int, int, int]) -> float:
        now, want = self.state[split], self.target[split]
        off = [abs(a + b - t) / max(t, 1) for a, b, t in zip(now, group, want, strict=True)]
        new = sum(1 for k in (1, 2) if now[k] == 0 and group[k] > 0)
        return off[0] + 2 * (off[1] + off[2]) - 3 * new

    def add(self, split: str, group: tuple[int, int, int]) -> None:
        self.state[split] = [a + b for a, b in zip(self.state[split], group, strict=True)]

    def choose(self, group: tuple[int, int, int], objective: str) -> str:
        if objective == "delta":
            gain = {s: self.cost(s, group) - self.cost(s, (0, 0, 0)) for s in ORDER}
        else:
            gain = {s: self.cost(s, group) for s in ORDER}
        best = min(ORDER, key=lambda s: (gain[s], s))
        self.add(best, group)
        return best


def _stream(batches: Iterator[pa.RecordBatch], total, ratios, state, objective: str) -> Iterator[pa.RecordBatch]:
    sums = Sums(total, ratios, {s: list(x) for s, x in state.items()})
    for b in batches:
        rows = zip(*(b.column(k).to_pylist() for k in ("size", "human", "ai")), strict=True)
        yield pa.RecordBatch.from_arrays([b.column("group_id"), pa.array([sums.choose(g, objective) for g in rows], pa.string())], names=["group_id", "split"])


def assign_splits(groups: DataFrame, seed: int = 42, ratios: dict[str, float] | None = None, objective: str = "cost", order: str = "hash") -> DataFrame:
    """(group_id, split) for groups of (group_id, size, human, ai); larger groups first, ties in stable-hash order, or, with
    ``order="shuffle"``, in the order of a seeded Mersenne Twister shuffle of the sorted ids (of MAX_SHUFFLED at most).

    Each split opens with the group that comes closest to its targets. ``objective="delta"`` weighs the change of a
    split's cost instead of the cost, which comes nearer to the ratios.
    """
    ratios = ratios or RATIOS
    check_ratios(ratios)
    groups = materialise(groups.select("group_id", F.col("size").cast("long"), F.col("human").cast("long"), F.col("ai").cast("long")), "split-groups")
    t = groups.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "human", "ai")]).first()
    if t["n"] < len(ORDER):
        raise ValueError("three groups are needed at least")
    total = (t["size"], t["human"], t["ai"])
    sums, opened = Sums(total, ratios), []
    for s in ORDER:
        want = sums.target[s]
        off = sum(F.abs(F.col(c) - F.lit(float(w))) / F.lit(float(max(w, 1))) for c, w in zip(("size", "human", "ai"), want, strict=True))
        g = groups.where(~F.col("group_id").isin([x for x, _ in opened]) if opened else F.lit(True)).agg(F.min_by(F.struct("group_id", "size", "human", "ai"), F.struct(off, "group_id")).alias("g")).first()["g"]
        sums.add(s, (g["size"], g["human"], g["ai"]))
        opened.append((g["group_id"], s))
    rest = groups.where(~F.col("group_id").isin([x for x, _ in opened]))
    if order == "shuffle":
        if t["n"] > MAX_SHUFFLED:
            raise ValueError(f"a shuffle of over {MAX_SHUFFLED} groups isn't made on the driver; use the hash order")
        ids = sorted(r["group_id"] for r in rest.select("group_id").toLocalIterator())
        random.Random(seed).shuffle(ids)
        place = groups.sparkSession.createDataFrame([(g, k) for k, g in enumerate(ids)], "group_id string, h long")
        ranked = rest.join(place, "group_id")
    else:
        ranked = rest.withColumn("h", stable_rank(F.col("group_id"), seed))
    ordered = ranked.coalesce(1).sortWithinPartitions(F.col("size").desc(), "h").select("group_id", "size", "human", "ai")
    ship_package(groups.sparkSession)
    run = partial(_stream, total=total, ratios=ratios, state=sums.state, objective=objective)
    first = groups.sparkSession.createDataFrame(opened, "group_id string, split string")
    return first.unionByName(ordered.mapInArrow(run, "group_id string, split string"))


def shuffled_order(ids: list[str], sizes: dict[str, int], seed: int) -> list[str]:
    """The order of a seeded Mersenne Twister shuffle followed by a stable sort, larger groups first (for small lists)."""
    out = list(ids)
    random.Random(seed).shuffle(out)
    return sorted(out, key=lambda g: -sizes[g])
