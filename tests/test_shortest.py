"""Shortest paths from both ends against a plain search."""

from __future__ import annotations

import random

import pytest

from loomgraph.operators import fixpoint


def _quads(spark, edges):
    rows = [("urn:g", f"urn:{a}", "iri", p, f"urn:{b}", "iri") for a, p, b in edges]
    return spark.createDataFrame(rows, "g string, s string, s_kind string, p string, o string, o_kind string")


def _far(edges, start):
    near = {}
    for a, _, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    far, front, level = {start: 0}, {start}, 0
    while front:
        level += 1
        front = {y for x in front for y in near.get(x, ())} - set(far)
        far |= dict.fromkeys(front, level)
    return far


def test_random_graphs(spark):
    rng = random.Random(8)
    edges = sorted({(rng.randrange(24), rng.choice(["urn:p", "urn:q"]), rng.randrange(24)) for _ in range(30)})
    rows, said = _quads(spark, edges).cache(), set(edges)
    for start, goal, hops in [(0, 5, 8), (1, 17, 8), (3, 9, 8), (2, 2, 5), (7, 21, 2), (99, 1, 5)]:
        found = fixpoint.shortest_path(rows, f"urn:{start}", f"urn:{goal}", "urn:type", hops)
        want = _far(edges, start).get(goal)
        if want is None or want > hops:
            assert found is None
            continue
        steps = sorted(map(tuple, found.collect()))
        assert len(steps) == want
        at = start
        for number, (step, a, p, b, forward) in enumerate(steps, 1):
            a, b = int(a[4:]), int(b[4:])
            assert step == number and a == at and ((a, p, b) if forward else (b, p, a)) in said
            at = b
        assert at == goal


@pytest.mark.parametrize("start,goal", [("hub", "end"), ("end", "hub"), ("leaf1", "end")])
def test_a_hub_is_not_expanded_from_the_far_side(spark, monkeypatch, start, goal):
    """A node with 3,000 edges and a chain that leads to it: the rows that the search keeps stay few."""
    edges = [("hub", "urn:p", f"leaf{i}") for i in range(3000)] + [("hub", "urn:p", "c1"), ("c1", "urn:p", "c2"), ("c2", "urn:p", "end")]
    kept = []
    real = fixpoint.Growing.add

    def add(self, df):
        out = real(self, df)
        if self.root.endswith("seen"):
            kept.append(out.count())
        return out

    monkeypatch.setattr(fixpoint.Growing, "add", add)
    found = fixpoint.shortest_path(_quads(spark, edges), f"urn:{start}", f"urn:{goal}", "urn:type")
    assert found.count() == (4 if start == "leaf1" else 3)
    assert sum(kept) < 20
