"""Joins, optional parts and differences of solutions with unbound variables, by their definition and by their plans; paths with given ends."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import algebra as A
from loomgraph.operators import fixpoint, paths

VARS = ("x", "y", "z")


def _rows(seed, n=40):
    rng = random.Random(seed)
    return [(rng.choice(["<a>", "<b>", None]), rng.choice(["<c>", "<d>", "<e>", None]), f"<k{rng.randrange(3)}>", f"<{seed}-{rng.randrange(4)}>") for _ in range(n)]


def _fits(a, b, n):
    return all(x is None or y is None or x == y for x, y in zip(a[:n], b[:n], strict=True))


def _merge(a, b, n):
    return tuple(x if x is not None else y for x, y in zip(a[:n], b[:n], strict=True))


@pytest.fixture(scope="module")
def sides(spark):
    names = lambda own: f"x string, y string, z string, {own} string"
    return spark.createDataFrame(_rows(1), names("a")), spark.createDataFrame(_rows(2), names("b"))


def _count(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def test_join(sides):
    want = Counter((*_merge(a, b, 3), a[3], b[3]) for a in _rows(1) for b in _rows(2) if _fits(a, b, 3))
    assert _count(A.join(*sides, unbound=("x", "y")), *VARS, "a", "b") == want


def test_optional(sides):
    want = Counter()
    for a in _rows(1):
        found = [(*_merge(a, b, 3), a[3], b[3]) for b in _rows(2) if _fits(a, b, 3) and b[3] != "<2-1>"]
        want.update(found or [(*a, None)])
    assert _count(A.optional(*sides, condition=F.col("b") != "<2-1>", unbound=("x", "y")), *VARS, "a", "b") == want


@pytest.mark.parametrize("names", [("x", "y", "z"), ("x", "y"), ("x",)])
def test_minus(sides, names):
    a, b = sides
    b = b.select(*names, "b").filter("b <> '<2-0>'")
    n = len(names)
    want = Counter(
        r for r in _rows(1)
        if not any(q[3] != "<2-0>" and _fits(r, q, n) and any(r[i] is not None and q[i] is not None for i in range(n)) for q in _rows(2))
    )
    assert _count(A.minus(a, b, unbound=("x", "y")), *VARS, "a") == want


def test_plans_have_no_product(sides):
    for frame in (A.join(*sides, unbound=("x", "y")), A.optional(*sides, unbound=("x", "y")), A.minus(*sides, unbound=("x", "y"))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _reach(edges, a):
    found, front = set(), {a}
    while front:
        front = {y for x, y in edges if x in front} - found
        found |= front
    return found


def _edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"<n{rng.randrange(n)}>", f"<n{rng.randrange(n)}>") for _ in range(m)})


@pytest.mark.parametrize("seed,n,m", [(1, 12, 8), (2, 30, 30), (3, 25, 45), (4, 8, 40)])
def test_closure_over_components(spark, seed, n, m):
    edges = _edges(seed, n, m)
    frame = spark.createDataFrame(edges, "a string, b string")
    want = {(a, b) for a in {x for e in edges for x in e} for b in _reach(edges, a)}
    found = [tuple(r) for r in paths.condensed_closure(frame).collect()]
    assert set(found) == want and len(found) == len(want)
    member = {r["node"]: r["component"] for r in paths.strong_components(frame).collect()}
    nodes = {x for e in edges for x in e}
    alike = {x: min(y for y in nodes if y == x or ((x, y) in want and (y, x) in want)) for x in nodes}
    assert member == {x: c for x, c in alike.items() if list(alike.values()).count(c) > 1}


def test_a_ring_is_not_squared(spark, monkeypatch):
    """The closure of a ring with a tail is made of one node and the tail."""
    ring = [(f"<r{i:03d}>", f"<r{(i + 1) % 12:03d}>") for i in range(12)] + [("<r005>", "<t0>"), ("<t0>", "<t1>")]
    asked = []
    real = fixpoint.closure
    monkeypatch.setattr(paths, "closure", lambda e, *a, **b: asked.append(e.count()) or real(e, *a, **b))
    assert paths.condensed_closure(spark.createDataFrame(ring, "a string, b string")).count() == 12 * 14 + 1
    assert asked == [2]


def test_paths_with_a_given_end(spark, monkeypatch):
    """They build no closure, and their rows are those of the whole path."""
    edges = _edges(5, 20, 30)
    quads = [("urn:g", a[1:-1], "iri", "urn:p", b[1:-1], "iri", b) for a, b in edges]
    rows = spark.createDataFrame(quads, "g string, s string, s_kind string, p string, o string, o_kind string, o_key string")
    step = paths.link("urn:p")
    tried = [
        paths.plus(step), paths.star(step), paths.maybe(step), paths.inverse(paths.plus(step)), paths.seq(step, paths.star(step)), paths.alt(step, paths.inverse(step)),
        paths.plus(paths.alt(step, paths.inverse(step))), paths.star(paths.seq(step, step)),
    ]
    whole = [sorted(map(tuple, paths.match(rows, "?x", path, "?y").collect())) for path in tried]

    def none(*a, **b):
        raise AssertionError("a closure of all pairs")

    monkeypatch.setattr(paths, "closure", none)
    for path, pairs in zip(tried, whole, strict=True):
        for node in ("<n3>", "<n7>"):
            assert sorted(r[0] for r in paths.match(rows, node, path, "?y").collect()) == sorted(b for a, b in pairs if a == node)
            assert sorted(r[0] for r in paths.match(rows, "?x", path, node).collect()) == sorted(a for a, b in pairs if b == node)
