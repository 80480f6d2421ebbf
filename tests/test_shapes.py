"""Nested shapes, paths and compared values against a plain evaluation, and shapes as quads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import terms as t
from loomgraph.operators import shapes as S
from loomgraph.operators.graph_edit import of_keys

EX = "http://x/"
iri = lambda x: f"<{EX}{x}>"
num = lambda x: f'"{x}"^^<{t.XSD}integer>'


def _facts():
    rng = random.Random(4)
    rows = [(iri(f"n{i}"), f"<{t.TYPE}>", iri("C")) for i in range(0, 24, 2)]
    for i in range(24):
        rows += [(iri(f"n{i}"), iri("to"), iri(f"n{rng.randrange(24)}")) for _ in range(rng.randrange(4))]
        rows += [(iri(f"n{i}"), iri("size"), num(rng.randrange(12))) for _ in range(rng.randrange(3))]
        rows += [(iri(f"n{i}"), iri("limit"), num(rng.randrange(12))) for _ in range(rng.randrange(3))]
        rows += [(iri(f"n{i}"), iri("name"), f'"{rng.choice("abc")}"') for _ in range(rng.randrange(3))]
    rows += [(iri("n4"), iri("size"), '"text"'), (iri("n6"), iri("limit"), '"text"'), (iri("n8"), iri("to"), "_:b1"), ("_:b1", iri("to"), '"leaf"')]
    return sorted(set(rows))


def _walk(facts, path, a):
    if path == S.SELF:
        return {a}
    if isinstance(path, str):
        return {o for s, p, o in facts if s == a and p == f"<{path}>"}
    kind, *parts = path
    if kind == "inverse" and isinstance(parts[0], str):
        return {s for s, p, o in facts if o == a and p == f"<{parts[0]}>"}
    if kind == "inverse":
        nodes = {x for s, _, o in facts for x in (s, o)}
        return {x for x in nodes if a in _walk(facts, parts[0], x)}
    if kind == "seq":
        found = {a}
        for part in parts:
            found = {y for x in found for y in _walk(facts, part, x)}
        return found
    if kind == "alt":
        return {y for part in parts for y in _walk(facts, part, a)}
    if kind == "maybe":
        return {a} | _walk(facts, parts[0], a)
    found, front = set(), {a}
    while front:
        front = {y for x in front for y in _walk(facts, parts[0], x)} - found
        found |= front
    return found | ({a} if kind == "star" else set())


def _value(key):
    return int(key.split('"')[1]) if key.endswith("integer>") else None


def _plain(facts, shapes):
    by = {s.name: s for s in shapes}

    def conforms(name, node):
        return not findings(by[name], node)

    def findings(shape, node):
        out = []
        for p in shape.properties:
            values = _walk(facts, p.path, node)
            add = lambda kind, v=None, p=p: out.append((node, S.spelled(p.path), kind, v))
            for v in values:
                if p.min_inclusive is not None and not (_value(v) is not None and _value(v) >= p.min_inclusive):
                    add("MinInclusive", v)
                if p.node_kind == "IRI" and not v.startswith("<"):
                    add("NodeKind", v)
                fits = lambda names, v=v: [conforms(x, v) for x in names]
                if not all(fits(p.node)):
                    add("Node", v)
                if not all(fits(p.all_of)):
                    add("And", v)
                if p.any_of and not any(fits(p.any_of)):
                    add("Or", v)
                if p.just_one_of and sum(fits(p.just_one_of)) != 1:
                    add("Xone", v)
                if any(fits(p.none_of)):
                    add("Not", v)
            if p.min_count is not None and len(values) < p.min_count:
                add("MinCount")
            if p.max_count is not None and len(values) > p.max_count:
                add("MaxCount")
            if p.has_value is not None and p.has_value not in values:
                add("HasValue")
            if p.qualified:
                n = sum(conforms(p.qualified, v) for v in values)
                if p.qualified_min is not None and n < p.qualified_min:
                    add("QualifiedMinCount")
                if p.qualified_max is not None and n > p.qualified_max:
                    add("QualifiedMaxCount")
            other = lambda x, node=node: _walk(facts, x, node)
            if p.equals:
                for v in values ^ other(p.equals):
                    add("Equals", v)
            if p.disjoint:
                for v in values & other(p.disjoint):
                    add("Disjoint", v)
            for name, kind, test in ((p.less_than, "LessThan", lambda a, b: a < b), (p.less_than_or_equals, "LessThanOrEquals", lambda a, b: a <= b)):
                if name:
                    for v in values:
                        if any(_value(v) is None or _value(o) is None or not test(_value(v), _value(o)) for o in other(name)):
                            add(kind, v)
        return out

    out = []
    for shape in shapes:
        targets = {s for s, p, o in facts if p == f"<{t.TYPE}>" and shape.target_class and o == f"<{shape.target_class}>"} | set(shape.target_nodes)
        targets |= {s for s, p, _ in facts if p[1:-1] in shape.target_subjects_of} | {o for _, p, o in facts if p[1:-1] in shape.target_objects_of}
        out += [(shape.name, *f) for node in targets for f in findings(shape, node)]
    return sorted(out, key=repr)


P = S.Property
SHAPES = [
    S.Shape("big", None, [P(EX + "size", min_inclusive=6.0, min_count=1)]),
    S.Shape("linked", None, [P(EX + "to", min_count=1, node_kind="IRI")]),
    S.Shape("both", None, [P(S.SELF, all_of=("big", "linked"))]),
    S.Shape("deep", None, [P(EX + "to", node=("both",)), P(S.SELF, none_of=("big",))]),
    S.Shape("c", EX + "C", [P(S.SELF, any_of=("big", "deep")), P(S.SELF, just_one_of=("both", "linked", "deep")), P(EX + "to", none_of=("both",), qualified="linked", qualified_min=1, qualified_max=1)]),
    S.Shape("more", None, [P(("seq", EX + "to", EX + "to"), any_of=("both", "deep"), max_count=4)], target_subjects_of=(EX + "size",)),
    S.Shape("ends", None, [P(("inverse", EX + "to"), node=("linked",), max_count=1)], target_objects_of=(EX + "to",), target_nodes=(iri("outside"),)),
    S.Shape("compare", EX + "C", [P(EX + "size", less_than=EX + "limit"), P(EX + "size", less_than_or_equals=EX + "limit"), P(EX + "size", equals=EX + "limit"), P(EX + "size", disjoint=EX + "limit")]),
    S.Shape("paths", EX + "C", [
        P(("plus", EX + "to"), max_count=6), P(("star", ("alt", EX + "to", ("inverse", EX + "to"))), has_value=iri("n3")), P(("maybe", ("seq", EX + "to", EX + "name")), has_value='"a"'),
        P(("inverse", ("seq", EX + "to", EX + "to")), min_count=2), P(("alt", EX + "size", EX + "limit"), max_count=2),
    ]),
]


def _rows(found):
    return sorted(((r["shape"], r["focus"], r["path"], r["constraint"].removesuffix("ConstraintComponent"), r["value"]) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(_facts(), "s string, p string, o string").repartition(2)


def test_nested_shapes_paths_and_pairs(facts):
    assert _rows(S.validate(facts, SHAPES)) == _plain(_facts(), SHAPES)


def test_shapes_as_quads(spark, facts):
    none = of_keys(spark.createDataFrame([], "g string, sk string, pk string, ok string"))
    rows = none
    for shape in [S.Shape("c", EX + "Old", [P(("seq", EX + "a", EX + "b"), one_of=('"x"',))]), *SHAPES]:
        rows = S.save(rows, shape)
    loaded = S.load(rows)
    assert [s.name for s in loaded] == sorted(s.name for s in SHAPES)
    assert _rows(S.validate(facts, loaded)) == _plain(_facts(), SHAPES)
    extra = [
        S.Shape("all", EX + "C", [P(EX + "p", one_of=('"a"', iri("b"), num(3)), has_value=num(1), unique_lang=True, severity="Warning", message='say "it"\nso', pattern="a\\\\d", datatype=t.XSD + "string", max_exclusive=4.0)], closed=True, ignore_type=True),
        S.Shape("all-1", EX + "D", [P(EX + "q", min_count=1)]),
    ]
    for shape in extra:
        rows = S.save(rows, shape)
    found = {s.name: s for s in S.load(rows)}
    assert [found[s.name] for s in extra] == extra
    assert {s.name for s in S.load(S.remove(rows, "all"))} == {s.name for s in [*SHAPES, extra[1]]}


def test_shapes_written_by_hand(spark, facts):
    from loomgraph.sources import turtle

    text = f"""@prefix sh: <{t.SH}> . @prefix x: <{EX}> .
    x:S a sh:NodeShape ; sh:targetClass x:C ; sh:property [ sh:path x:to ; sh:node [ sh:property [ sh:path x:size ; sh:minCount 1 ] ] ; sh:maxCount 2 ] ;
      sh:or ( [ sh:path x:size ; sh:minInclusive 6 ; sh:minCount 1 ] [ sh:not x:T ] ) . x:T sh:property [ sh:path ( x:to [ sh:inversePath x:to ] ) ; sh:minCount 3 ] ."""
    rows = turtle._Reader(text, EX, "h").document()
    quads = of_keys(spark.createDataFrame(rows, "g string, sk string, pk string, ok string").withColumn("g", F.lit(t.SHAPES)))
    same = [
        S.Shape("v", None, [P(EX + "size", min_count=1)]), S.Shape("big", None, [P(EX + "size", min_inclusive=6.0, min_count=1)]), S.Shape("t", None, [P(("seq", EX + "to", ("inverse", EX + "to")), min_count=3)]),
        S.Shape("nt", None, [P(S.SELF, none_of=("t",))]), S.Shape(iri("S"), EX + "C", [P(EX + "to", node=("v",), max_count=2), P(S.SELF, any_of=("big", "nt"))]),
    ]
    assert _rows(S.validate(facts, S.load(quads))) == _plain(_facts(), same)


def test_errors(facts):
    with pytest.raises(ValueError, match="lead back"):
        S.validate(facts, [S.Shape("a", EX + "C", [P(S.SELF, none_of=("b",))]), S.Shape("b", None, [P(EX + "to", node=("a",))])])
    with pytest.raises(ValueError, match="no shape"):
        S.validate(facts, [S.Shape("a", EX + "C", [P(S.SELF, none_of=("b",))])])
    with pytest.raises(ValueError, match="one name"):
        S.validate(facts, [S.Shape("a"), S.Shape("a")])


def test_one_shape(facts):
    assert _rows(S.validate_one(facts, SHAPES, "c")) == [r for r in _plain(_facts(), SHAPES) if r[0] == "c"]
    assert S.validate(facts.limit(0), SHAPES).filter("shape <> 'ends'").count() == 0


@pytest.mark.parametrize("more", ["sh:property [ sh:path x:to ; sh:languageIn ( \"en\" ) ]", "sh:sparql [ ]", "sh:property [ sh:path x:to ; sh:property [ sh:path x:size ] ]", "sh:targetClass x:D"])
def test_shapes_that_are_not_read(spark, more):
    from loomgraph.sources import turtle

    rows = turtle._Reader(f"@prefix sh: <{t.SH}> . @prefix x: <{EX}> . x:S a sh:NodeShape ; sh:targetClass x:C ; {more} .", EX, "h").document()
    quads = of_keys(spark.createDataFrame(rows, "g string, sk string, pk string, ok string").withColumn("g", F.lit(t.SHAPES)))
    with pytest.raises(ValueError, match="not read|more than one"):
        S.load(quads)
