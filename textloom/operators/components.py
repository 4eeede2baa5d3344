"""Connected components of an edge list, by alternating star contractions.

Each round links every vertex's larger neighbours to its smallest neighbour (large star), then its smaller neighbours and
itself to the smallest (small star). The number of rounds grows with the logarithm of the longest chain. No vertex's
neighbours are gathered: the smallest comes from a partial aggregation, and rows are re-linked by a join on it that
adaptive execution can split. Every round is written to the shared folder, so lineage stays short.

In larger graphs vertices with a single neighbour stay out of the rounds, as they connect nothing: they take their
neighbour's component afterwards, and the smallest of them may become its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import discard, materialise

MAX_ROUNDS = 60
#: Rows of edges that a task takes; a few edges don't need all shuffle partitions' tasks.
ROWS_A_TASK = 50_000
#: Edges from which leaving out leaves saves more than its own jobs take.
LEAVES_FROM = 100_000


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(vertex, component) for every vertex of an edge; the component is its smallest vertex. Null ends are left out."""
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = e.where(F.col("u") == F.col("v")).select(F.col("u").alias("vertex"))
    e = e.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "edges")
    before = _digest(e)
    found = _without_leaves(e, before[0]) if before[0] >= LEAVES_FROM else _rounds(e, before)
    alone = loops.distinct().join(found.select("vertex"), "vertex", "left_anti")
    return found.union(alone.select("vertex", F.col("vertex").alias("component")))


def _both_ways(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _rounds(e: DataFrame, before: tuple) -> DataFrame:
    """(vertex, component) of distinct edges with u > v, which were written and are deleted."""
    tasks = 2 * before[0] // ROWS_A_TASK + 1
    for _ in range(MAX_ROUNDS if before[0] else 0):
        both = _both_ways(e).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        last, e = e, materialise(small.distinct().coalesce(tasks), "edges")
        after = _digest(e)
        discard(last)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)


def _without_leaves(e: DataFrame, rows: int) -> DataFrame:
    """The same, with the rounds run on the edges between vertices of several neighbours only."""
    tasks = 2 * rows // ROWS_A_TASK + 1
    ends = _both_ways(e).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("hub"))
    leaves = materialise(ends.where("n = 1").select(F.col("u").alias("leaf"), "hub").coalesce(tasks), "leaves")
    inner = e.join(leaves.select(F.col("leaf").alias("u")), "u", "left_anti").join(leaves.select(F.col("leaf").alias("v")), "v", "left_anti")
    core = materialise(inner.select("u", "v").coalesce(tasks), "edges")
    discard(e)
    found = _rounds(core, _digest(core))
    # Each hub with its smallest leaf, and the hub's component in the core; a hub out of the core is the only one of its component,
    # but for two vertices that are each other's single neighbour: both are hubs and leaves.
    hubs = leaves.groupBy("hub").agg(F.min("leaf").alias("least")).join(found.withColumnRenamed("vertex", "hub"), "hub", "left")
    hubs = materialise(hubs.coalesce(tasks), "hubs")
    inside, outside = hubs.where("component is not null"), hubs.where("component is null").select("hub", F.least("hub", "least").alias("name"))
    lows = inside.groupBy("component").agg(F.min("least").alias("least"))
    named = lambda df, key: df.join(lows, "component", "left").select(key, F.least("component", "least").alias("name"))
    names = named(inside.drop("least"), "hub").union(outside)
    of_leaves = leaves.join(names, "hub").select("leaf", "name")
    only_hubs = outside.join(leaves.select(F.col("leaf").alias("hub")), "hub", "left_anti")
    return named(found, "vertex").union(only_hubs).union(of_leaves).toDF("vertex", "component")
