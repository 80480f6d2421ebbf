"""Classes of equal IRIs against the rules applied pair by pair."""

from __future__ import annotations

import random

import pytest

from loomgraph.functions import terms as t
from loomgraph.operators import fixpoint, same_as
from loomgraph.operators import inference as I

SAME, TYPE, SUB, SUBP = (f"<{x}>" for x in (t.OWL + "sameAs", t.TYPE, t.RDFS + "subClassOf", t.RDFS + "subPropertyOf"))


def _all(spark, facts):
    frame = spark.createDataFrame(facts, "s string, p string, o string")
    done = I.materialise(frame)
    assert done.reached_fixed_point
    return {tuple(r) for r in frame.collect()} | {tuple(r) for r in done.derivations.select("s", "p", "o").collect()}


PROPERTIES = [("<p>", SUBP, "<q>"), ("<q>", TYPE, f"<{t.OWL}TransitiveProperty>"), ("<eq>", SUBP, SAME), ("<C>", SUB, "<D>"), ("<q>", f"<{t.RDFS}domain>", "<E>")]
CASES = {
    "plain": [("<a>", SAME, "<b>"), ("<c>", SAME, "<b>"), ("<a>", "<p>", "<x>"), ("<y>", "<p>", "<c>"), ("<x>", TYPE, "<C>")],
    "derived": [("<a>", "<eq>", "<b>"), ("<b>", "<eq>", "<c>"), ("<c>", SAME, "<d>"), ("<d>", "<p>", "<a>"), ("<z>", "<p>", "<d>")],
    "classes": [("<C>", SAME, "<C2>"), ("<x>", TYPE, "<C2>"), ("<x>", SAME, "<x2>")],
    "properties": [("<p>", SAME, "<p2>"), ("<a>", "<p2>", "<b>"), ("<b>", "<p>", "<c>"), ("<a>", SAME, "<a2>"), ("<p2>", "<note>", '"n"')],
    "odd terms": [("<a>", SAME, '"text"'), ("_:b", SAME, "<a>"), ("<a>", SAME, "<a2>"), ("_:b", "<p>", "<z>"), ("<z>", "<p>", "_:b"), ("<s>", SAME, "<s>")],
    "becomes a property": [("<m>", SAME, "<n>"), ("<k>", "<meta>", "<n>"), ("<meta>", SUBP, SUBP), ("<u>", "<k>", "<v>")],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    facts = PROPERTIES + CASES[name]
    found = [tuple(r) for r in same_as.materialise(spark.createDataFrame(facts, "s string, p string, o string")).expand().collect()]
    assert set(found) == _all(spark, facts) and len(found) == len(set(found))


def test_random_graphs(spark):
    rng = random.Random(6)
    for _ in range(1):
        node = lambda: f"<n{rng.randrange(8)}>"
        facts = PROPERTIES + sorted({(node(), rng.choice([SAME, "<p>", "<q>", "<eq>", TYPE]), node()) for _ in range(9)})
        found = same_as.materialise(spark.createDataFrame(facts, "s string, p string, o string"))
        want = _all(spark, facts)
        assert {tuple(r) for r in found.expand().collect()} == want
        for s, p, o in [("<n1>", None, None), (None, SAME, "<n2>"), ("<n3>", "<q>", None), ("<n1>", SAME, "<n4>"), (None, None, "<n5>")]:
            fits = lambda r, s=s, p=p, o=o: all(x is None or x == y for x, y in zip((s, p, o), r, strict=True))
            assert {tuple(r) for r in found.match(s, p, o).collect()} == {r for r in want if fits(r)}


def test_a_large_class_is_not_squared(spark):
    """A chain of 10,000 equal nodes: as many rows, and the facts of one of them on demand."""
    n = 10_000
    facts = [(f"<n{i:05d}>", SAME, f"<n{i + 1:05d}>") for i in range(n - 1)] + [("<n07777>", "<p>", '"v"')]
    found = same_as.materialise(spark.createDataFrame(facts, "s string, p string, o string"))
    assert found.classes.count() == n and found.facts.count() == 1
    assert [tuple(r) for r in found.match("<n00123>", "<p>").collect()] == [("<n00123>", "<p>", '"v"')]
    assert found.match("<n00123>", SAME).count() == n


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"{rng.randrange(60):02d}", f"{rng.randrange(60):02d}") for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["component"] for r in fixpoint.components(spark.createDataFrame(edges, "a string, b string")).collect()} == root
