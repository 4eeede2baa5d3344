"""Steps whose work must not grow with what connects nothing or differs in nothing."""

import random

import pytest

from textloom.operators import components, pilot


def by_hand(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_components_without_leaves_equal_plain_ones(spark, monkeypatch, seed):
    r = random.Random(seed)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(70)]
    edges += [(200, 201), (301, 300), (300, 301), (400, 400), (500, 501), (500, 502), (610, 600), (610, 601), (602, 610), (600, 603)]  # pairs, loops, stars
    edges += [(1000 + k, 1001 + k) for k in range(20)] + [(1000 + k, 700 + k) for k in range(20)]  # a chain whose smallest vertex is a leaf
    monkeypatch.setattr(components, "LEAVES_FROM", 0)
    got = components.connected_components(spark.createDataFrame([*edges, (None, 3)], "u int, v int")).collect()
    assert len(got) == len({x["vertex"] for x in got})
    assert {x["vertex"]: x["component"] for x in got} == by_hand(edges)


def test_rounds_take_no_leaves(spark, monkeypatch):
    edges = [(f"s{k}", f"a{k}-{i}") for k in range(30) for i in range(9)] + [(f"s{k}", f"hub{k // 10}") for k in range(30)] + [("s0", "hub1"), ("s1", "hub1")]
    taken, rounds = [], components._rounds
    monkeypatch.setattr(components, "LEAVES_FROM", 0)
    monkeypatch.setattr(components, "_rounds", lambda e, before: taken.append(before[0]) or rounds(e, before))
    got = {x["vertex"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert taken == [32] and got == by_hand(edges)  # of 302


@pytest.mark.parametrize("seed", range(2))
def test_selection_brings_few_ids_and_follows_the_plain_rule(spark, monkeypatch, seed):
    r = random.Random(seed)
    groups = {f"g{k:04d}": (r.choice((1, 1, 1, 2, 3, 40)), {(x, str(r.randrange(n))) for x, n in (("model", 4), ("domain", 9), ("attack", 5)) for _ in range(r.randint(1, 2))}) for k in range(600)}
    df = spark.createDataFrame([(g, h + 2, h, 2, sorted(c)) for g, (h, c) in groups.items()], "group_id string, rows long, human long, ai long, coverage array<struct<kind:string,value:string>>")
    goal, have, covered, left, want = 50, 0, set(), dict(groups), []
    while have < goal:
        g = min(left, key=lambda g: (abs(have + left[g][0] - goal) / goal + 3 * max(0, have + left[g][0] - goal) / goal - 0.03 * len(left[g][1] - covered), g))
        h, c = left.pop(g)
        have, covered = have + h, covered | c
        want.append(g)
    sizes, plain = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (lambda x: sizes.append(len(x)) or x)(plain(self)))
    monkeypatch.setattr(type(df), "toLocalIterator", lambda self, *a, **k: iter(self.collect()))
    got = pilot.select_groups(df, 100)
    found = sizes[:]
    assert sorted(x["group_id"] for x in got.collect()) == sorted(want)
    classes = len({(h, frozenset(c)) for h, c in groups.values()})
    assert max(found) <= classes + sum(-(-goal // h) for h in (1, 2, 3, 40))
