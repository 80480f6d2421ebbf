"""Validation of nodes against shapes: each constraint is one filter or join.

``facts`` has s, p, o as keys.  Results are findings: focus, path, constraint,
value, severity, message, suggestion.

Shapes may name other shapes (and, or, not, xone, node, qualified values).  Such
references form a graph without cycles, which is evaluated in two passes over its
strata: from the targets down, to find which nodes are asked about which shape,
and back up, where conformance is a relation (shape, node): a node that is asked
about and not among the failures of a shape conforms to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..storage import KeyTables
from . import paths
from .algebra import datatype, language, number, text
from .fixpoint import closure
from .graph_edit import of_keys

#: The path of a constraint on the focus node itself.
SELF = ""
#: A predicate, SELF, or ("inverse" | "star" | "plus" | "maybe", path), ("seq" | "alt", path, path, ...).
Path = str | tuple


@dataclass(frozen=True)
class Property:
    path: Path
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    cls: str | None = None
    pattern: str | None = None
    message: str | None = None
    severity: str = "Violation"
    min_length: int | None = None
    max_length: int | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    one_of: tuple[str, ...] | None = None
    has_value: str | None = None
    unique_lang: bool = False
    min_exclusive: float | None = None
    max_exclusive: float | None = None
    #: One of IRI, BlankNode, Literal, BlankNodeOrIRI, BlankNodeOrLiteral, IRIOrLiteral.
    node_kind: str | None = None
    #: Names of shapes that each value must, or must not, conform to.
    node: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    just_one_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    #: Values that conform to this shape: how many there must, and may, be.
    qualified: str | None = None
    qualified_min: int | None = None
    qualified_max: int | None = None
    #: Predicates whose values at the focus node are compared with those of the path.
    equals: str | None = None
    disjoint: str | None = None
    less_than: str | None = None
    less_than_or_equals: str | None = None


@dataclass(frozen=True)
class Shape:
    name: str
    target_class: str | None = None
    properties: list[Property] = field(default_factory=list)
    closed: bool = False
    ignore_type: bool = False
    target_nodes: tuple[str, ...] = ()
    target_subjects_of: tuple[str, ...] = ()
    target_objects_of: tuple[str, ...] = ()


# fixed values: a hint for each constraint component
SUGGESTIONS = {
    "MinCountConstraintComponent": "Add a value for {path}.",
    "MaxCountConstraintComponent": "Remove values of {path} until few enough are left.",
    "DatatypeConstraintComponent": "Give {path} a value of the required datatype.",
    "ClassConstraintComponent": "Point {path} at an instance of the required class.",
    "NodeKindConstraintComponent": "Point {path} at a node instead of a literal.",
    "PatternConstraintComponent": "Change the value of {path} to fit the pattern.",
    "ClosedConstraintComponent": "Remove {path} or add it to the shape.",
}


COLUMNS = "shape string, focus string, path string, constraint string, value string, severity string, message string, suggestion string"
_KINDS = {"IRI": "<", "BlankNode": "_:", "Literal": '"'}
#: Fields that name shapes, the constraint each is, and whether a value fails by (number of shapes, number it fails).
_LOGIC = {
    "node": ("Node", lambda n, failed: failed > 0),
    "all_of": ("And", lambda n, failed: failed > 0),
    "any_of": ("Or", lambda n, failed: failed == n),
    "just_one_of": ("Xone", lambda n, failed: n - failed != 1),
    "none_of": ("Not", lambda n, failed: failed < n),
}


def spelled(path: Path) -> str:
    """A path as SPARQL writes it; a predicate is its IRI."""
    if isinstance(path, str):
        return path
    kind, *parts = path
    inner = [f"<{p}>" if isinstance(p, str) else f"({spelled(p)})" for p in parts]
    if kind in ("seq", "alt"):
        return ("/" if kind == "seq" else "|").join(inner)
    return f"^{inner[0]}" if kind == "inverse" else inner[0] + {"star": "*", "plus": "+", "maybe": "?"}[kind]


def _members(facts: DataFrame, classes: list[str], tables: KeyTables) -> DataFrame:
    """(cls, node) of every node whose type is one of ``classes`` or a descendant of it, by one scan of the types.

    Only what lies below the classes asked for is followed.
    """
    down = facts.filter(F.col("p") == f"<{t.RDFS}subClassOf>").select(F.col("o").alias("a"), F.col("s").alias("b"))
    own = facts.sparkSession.createDataFrame([(f"<{c}>", c) for c in classes], "o string, cls string")
    name = F.regexp_extract("a", "^<(.*)>$", 1)
    below = closure(down, seeds=own.select(F.col("o").alias("a"))).select(F.col("b").alias("o"), name.alias("cls")).union(own).distinct()
    typed = facts.filter(F.col("p") == f"<{t.TYPE}>").select(F.col("s").alias("node"), "o")
    return tables.cut(typed.join(tables.cut(below, "below"), "o").select("cls", "node").distinct(), "members")


def _choose(key: Column, choices: dict[str, list[int]]) -> Column:
    """The numbers that ``choices`` gives for a key, none for any other."""
    pairs = [x for k, numbers in choices.items() for x in (F.lit(k), F.array(*map(F.lit, numbers)))]
    return F.try_element_at(F.create_map(*pairs), key)


def _depths(shapes: list[Shape]) -> dict[str, int]:
    """How many references lead down from each shape at most; a shape that leads back to itself is an error."""
    refs = {s.name: {x for p in s.properties for x in _references(p)} for s in shapes}
    if len(refs) < len(shapes):
        raise ValueError("two shapes have one name")
    if unknown := sorted({x for named in refs.values() for x in named} - set(refs)):
        raise ValueError(f"no shape {', '.join(unknown)}")
    depth: dict[str, int] = {}
    while len(depth) < len(refs):
        ready = [s for s, named in refs.items() if s not in depth and named <= set(depth)]
        if not ready:
            raise ValueError(f"shapes that lead back to themselves: {', '.join(sorted(set(refs) - set(depth)))}")
        depth |= {s: 1 + max((depth[x] for x in refs[s]), default=-1) for s in ready}
    return depth


def _references(p: Property) -> list[str]:
    return [x for kind in _LOGIC for x in getattr(p, kind)] + ([p.qualified] if p.qualified else [])


def _targets(facts: DataFrame, shapes: list[Shape], members: DataFrame) -> DataFrame:
    """(shape, focus) of the targets of all shapes."""
    spark = facts.sparkSession
    by: dict[str, dict[str, list[int]]] = {"class": {}, "s": {}, "o": {}}
    nodes = [(i, x) for i, s in enumerate(shapes) for x in s.target_nodes]
    for i, s in enumerate(shapes):
        if s.target_class:
            by["class"].setdefault(s.target_class, []).append(i)
        for side, asked in (("s", s.target_subjects_of), ("o", s.target_objects_of)):
            for x in asked:
                by[side].setdefault(f"<{x}>", []).append(i)
    out = [spark.createDataFrame(nodes, "shape int, focus string")]
    if by["class"]:
        out.append(members.select(F.explode(_choose(F.col("cls"), by["class"])).alias("shape"), F.col("node").alias("focus")))
    for side in "so":
        if by[side]:
            said = facts.filter(F.col("p").isin(*by[side]))
            out.append(said.select(F.explode(_choose(F.col("p"), by[side])).alias("shape"), F.col(side).alias("focus")))
    return reduce(DataFrame.union, out).distinct()


def _walk(facts: DataFrame, path: Path, starts: DataFrame) -> DataFrame:
    """(a, b) along a path from the nodes in ``starts`` (a); values are a set."""
    if path == SELF:
        return starts.select("a", F.col("a").alias("b"))
    if isinstance(path, str):
        return facts.filter(F.col("p") == f"<{path}>").select(F.col("s").alias("a"), F.col("o").alias("b")).join(starts, "a", "left_semi").distinct()
    kind, *parts = path
    if kind == "inverse" and isinstance(parts[0], str):
        back = facts.filter(F.col("p") == f"<{parts[0]}>").select(F.col("o").alias("a"), F.col("s").alias("b"))
        return back.join(starts, "a", "left_semi").distinct()
    if kind == "inverse":
        return _walk(facts, _turned(parts[0]), starts)
    if kind == "seq":
        found = starts.select("a", F.col("a").alias("b"))
        for part in parts:
            step = _walk(facts, part, found.select(F.col("b").alias("a")).distinct())
            found = found.withColumnRenamed("b", "via").join(step.withColumnRenamed("a", "via"), "via").select("a", "b").distinct()
        return found
    if kind == "alt":
        return reduce(DataFrame.union, [_walk(facts, part, starts) for part in parts]).distinct()
    same = starts.select("a", F.col("a").alias("b"))
    if kind == "maybe":
        return _walk(facts, parts[0], starts).union(same).distinct()
    steps = lambda front: _walk(facts, parts[0], front)
    found = paths.reach(starts, steps)
    return found if kind == "plus" else found.union(same).distinct()


def _turned(path: Path) -> Path:
    """The path that leads back."""
    if isinstance(path, str):
        return ("inverse", path)
    kind, *parts = path
    if kind == "inverse":
        return parts[0]
    return (kind, *[_turned(x) for x in (reversed(parts) if kind == "seq" else parts)])


def _values(facts: DataFrame, focus: DataFrame, props: list[tuple[int, Property]]) -> DataFrame:
    """(shape, focus, prop, value) of all properties: predicates by one scan, SELF from the focus nodes, other paths by walks."""
    plain: dict[str, list[int]] = {}
    out = []
    for k, (i, p) in enumerate(props):
        if p.path == SELF:
            out.append(focus.filter(F.col("shape") == i).select("shape", "focus", F.lit(k).alias("prop"), F.col("focus").alias("value")))
        elif isinstance(p.path, str):
            plain.setdefault(f"{i} <{p.path}>", []).append(k)
        else:
            starts = focus.filter(F.col("shape") == i).select(F.col("focus").alias("a"))
            found = _walk(facts, p.path, starts)
            out.append(found.select(F.lit(i).alias("shape"), F.col("a").alias("focus"), F.lit(k).alias("prop"), F.col("b").alias("value")))
    if plain:
        said = facts.filter(F.col("p").isin(*{x.split(" ", 1)[1] for x in plain})).select(F.col("s").alias("focus"), "p", F.col("o").alias("value"))
        own = said.join(focus, "focus")
        out.append(own.select("shape", "focus", F.explode(_choose(F.concat_ws(" ", "shape", "p"), plain)).alias("prop"), "value"))
    return reduce(DataFrame.union, out)


class _Run:
    """One validation: its shapes, findings so far, and the nodes that fail each shape."""

    def __init__(self, facts: DataFrame, shapes: list[Shape]) -> None:
        self.facts, self.shapes, self.tables = facts, shapes, KeyTables(facts.sparkSession, "shapes")
        self.number = {s.name: i for i, s in enumerate(shapes)}
        self.props = [(i, p) for i, shape in enumerate(shapes) for p in shape.properties]
        self.names = F.array(*[F.lit(s.name) for s in shapes])
        self.found: list[DataFrame] = []

    def finding(self, p: Property | None, path: Column, kind: str, value: Column) -> Column:
        kind += "ConstraintComponent"
        hint = F.replace(F.lit(SUGGESTIONS.get(kind, "Change {path} to satisfy the shape.")), F.lit("{path}"), t.local_name(path))
        said = F.lit(p.message) if p and p.message else F.concat(F.lit(f"{kind}: "), t.local_name(path))
        severity = p.severity if p else "Violation"
        return F.struct(path.alias("path"), F.lit(kind).alias("constraint"), value.alias("value"), F.lit(severity).alias("severity"), said.alias("message"), hint.alias("suggestion"))

    def of(self, k: int, kind: str, value: Column) -> Column:
        p = self.props[k][1]
        return self.finding(p, F.lit(spelled(p.path)), kind, value)

    def add(self, rows: DataFrame, tests: list[tuple[Column, Column]]) -> None:
        """One finding for every test of (condition, finding) that a row meets."""
        if tests:
            found = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), what) for bad, what in tests])))
            self.found.append(rows.select("shape", "focus", found.alias("f")).select("shape", "focus", "f.*"))

    def take(self) -> DataFrame:
        """The findings added since the last call, written."""
        schema = COLUMNS.replace("shape string", "shape int")
        rows = reduce(DataFrame.union, self.found) if self.found else self.facts.sparkSession.createDataFrame([], schema)
        self.found = []
        return self.tables.cut(rows, "findings")

    def plain(self, focus: DataFrame, own: DataFrame | None, members: DataFrame | None) -> None:
        """Findings of all constraints that name no other shape."""
        props, shapes, facts = self.props, self.shapes, self.facts
        if own is not None:
            null, value, is_ = F.lit(None).cast("string"), F.col("value"), lambda k: F.col("prop") == k
            form, kind = text(value), datatype(value)
            tests: list[tuple[Column, Column]] = []
            counted: list[tuple[Column, Column]] = []
            for k, (_, p) in enumerate(props):
                checks = [
                    (p.datatype, "Datatype", lambda: ~value.startswith('"') | (kind != p.datatype) | ~t.lexically_valid(form, kind)),
                    (p.cls, "NodeKind", lambda: ~value.startswith("<")),
                    (p.node_kind, "NodeKind", lambda: ~reduce(Column.__or__, [value.startswith(m) for n, m in _KINDS.items() if n in p.node_kind.split("Or")])),
                    (p.pattern, "Pattern", lambda: value.startswith("_:") | ~form.rlike(p.pattern)),
                    (p.min_length, "MinLength", lambda: F.length(form) < p.min_length),
                    (p.max_length, "MaxLength", lambda: F.length(form) > p.max_length),
                    (p.min_inclusive, "MinInclusive", lambda: form.try_cast("double") < p.min_inclusive),
                    (p.max_inclusive, "MaxInclusive", lambda: form.try_cast("double") > p.max_inclusive),
                    (p.min_exclusive, "MinExclusive", lambda: form.try_cast("double") <= p.min_exclusive),
                    (p.max_exclusive, "MaxExclusive", lambda: form.try_cast("double") >= p.max_exclusive),
                    (p.one_of, "In", lambda: ~value.isin(*p.one_of)),
                ]
                for given, name, bad in checks:
                    if given is not None:
                        tests.append((is_(k) & F.coalesce(bad(), F.lit(True)), self.of(k, name, value)))
                n = F.col("n")
                for given, name, bad in ((p.min_count, "MinCount", lambda: n < p.min_count), (p.max_count, "MaxCount", lambda: n > p.max_count)):
                    if given is not None:
                        counted.append((is_(k) & bad(), self.of(k, name, null)))
                if p.has_value is not None:
                    counted.append((is_(k) & (F.array_position("has", k) == 0), self.of(k, "HasValue", null)))
                if p.unique_lang:
                    counted.append((is_(k) & F.col("twice"), self.of(k, "UniqueLang", null)))
            self.add(own, tests)
            if counted:
                fits = [F.when(is_(k) & (value == p.has_value), k) for k, (_, p) in enumerate(props) if p.has_value is not None]
                tag = F.nullif(F.lower(language(value)), F.lit(""))
                n = own.groupBy("shape", "focus", "prop").agg(
                    F.count("*").alias("n"), F.collect_set(F.coalesce(*fits, F.lit(None).cast("int"))).alias("has"), (F.count(tag) > F.countDistinct(tag)).alias("twice")
                )
                n = self.every(focus).join(n, ["shape", "focus", "prop"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "has": F.coalesce("has", F.array().cast("array<int>")), "twice": F.coalesce("twice", F.lit(False))})
                self.add(n, counted)
            typed = [(k, p) for k, (_, p) in enumerate(props) if p.cls]
            if typed:
                wanted = F.create_map(*[x for k, p in typed for x in (F.lit(k), F.lit(p.cls))])
                rows = own.filter(F.col("prop").isin(*[k for k, _ in typed])).withColumn("cls", wanted[F.col("prop")])
                rows = rows.join(members.withColumnRenamed("node", "value"), ["cls", "value"], "left_anti")
                self.add(rows, [(is_(k), self.of(k, "Class", value)) for k, p in typed])
            self.pairs(focus, own)
        closed = [i for i, shape in enumerate(shapes) if shape.closed]
        if closed:
            allowed = {i: [f"<{p.path}>" for p in shapes[i].properties if isinstance(p.path, str)] + ([f"<{t.TYPE}>"] if shapes[i].ignore_type else []) for i in closed}
            rows = facts.select(F.col("s").alias("focus"), "p", F.col("o").alias("value")).join(focus.filter(F.col("shape").isin(*closed)), "focus")
            odd = [((F.col("shape") == i) & ~F.col("p").isin(*names), self.finding(None, text(F.col("p")), "Closed", F.col("value"))) for i, names in allowed.items()]
            self.add(rows, odd)

    def every(self, focus: DataFrame) -> DataFrame:
        """(shape, focus, prop) of each property of each focus node, whether it has values or not."""
        asked = {str(i): [k for k, (j, _) in enumerate(self.props) if j == i] for i in range(len(self.shapes)) if self.shapes[i].properties}
        return focus.select("shape", "focus", F.explode(_choose(F.col("shape").cast("string"), asked)).alias("prop"))

    def pairs(self, focus: DataFrame, own: DataFrame) -> None:
        """Findings of values that are compared with those of another predicate at the same node."""
        kinds = {"equals": "Equals", "disjoint": "Disjoint", "less_than": "LessThan", "less_than_or_equals": "LessThanOrEquals"}
        asked = {f: [(k, getattr(p, f)) for k, (_, p) in enumerate(self.props) if getattr(p, f)] for f in kinds}
        if not any(asked.values()):
            return
        by: dict[str, list[int]] = {}
        for compared in asked.values():
            for k, other in compared:
                if k not in by.setdefault(f"{self.props[k][0]} <{other}>", []):
                    by[f"{self.props[k][0]} <{other}>"].append(k)
        said = self.facts.filter(F.col("p").isin(*{x.split(" ", 1)[1] for x in by})).select(F.col("s").alias("focus"), "p", F.col("o").alias("value")).join(focus, "focus")
        other = said.select("shape", "focus", F.explode(_choose(F.concat_ws(" ", "shape", "p"), by)).alias("prop"), "value", "p")
        other = self.tables.cut(other.distinct(), "others")
        keys, value = ["shape", "focus", "prop"], F.col("value")

        def of(field_: str) -> tuple[DataFrame, DataFrame, list[tuple[Column, Column]]]:
            numbers = [k for k, _ in asked[field_]]
            ours = own.filter(F.col("prop").isin(*numbers)).select(*keys, "value").distinct()
            match = reduce(Column.__or__, [(F.col("prop") == k) & (F.col("p") == f"<{x}>") for k, x in asked[field_]])
            return ours, other.filter(match).select(*keys, "value"), [(F.col("prop") == k, self.of(k, kinds[field_], value)) for k in numbers]

        if asked["equals"]:
            ours, theirs, tests = of("equals")
            self.add(ours.join(theirs, [*keys, "value"], "left_anti").union(theirs.join(ours, [*keys, "value"], "left_anti")), tests)
        if asked["disjoint"]:
            ours, theirs, tests = of("disjoint")
            self.add(ours.join(theirs, [*keys, "value"], "left_semi"), tests)
        for field_ in ("less_than", "less_than_or_equals"):
            if asked[field_]:
                ours, theirs, tests = of(field_)
                # a value lies below all others if it lies below the least of its kind and there is no other kind
                whole = theirs.groupBy(*keys).agg(F.count("*").alias("all"))
                least = theirs.select(*keys, *_ordered(value)).groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.min("x").alias("least_x"), F.min("y").alias("least_y"))
                rows = ours.select(*keys, "value", *_ordered(value)).join(whole, keys).join(least, [*keys, "kind"], "left")
                below = F.when(F.col("kind") == "text", F.col("y") < F.col("least_y")).otherwise(F.col("x") < F.col("least_x"))
                if field_ == "less_than_or_equals":
                    below |= F.when(F.col("kind") == "text", F.col("y") == F.col("least_y")).otherwise(F.col("x") == F.col("least_x"))
                fine = (F.col("kind") != "none") & (F.col("n") == F.col("all")) & below
                self.add(rows.filter(~F.coalesce(fine, F.lit(False))), tests)

    def nested(self, level: DataFrame, members: list[int], focus: DataFrame, failed: DataFrame) -> None:
        """Findings of the constraints of the shapes ``members`` that name other shapes.

        ``level`` has the values (shape, focus, prop, value) of these shapes, and
        ``failed`` (child, value) the nodes that fail the shapes named.
        """
        named: dict[str, list[tuple[int, str, list[int]]]] = {}
        for k, (i, p) in enumerate(self.props):
            if i in members:
                for kind in _LOGIC:
                    children = [self.number[x] for x in getattr(p, kind)]
                    if children:
                        named.setdefault(str(k), []).append((k, kind, children))
        asked = [(k, kind, c) for parts in named.values() for k, kind, children in parts for c in children]
        if asked:
            entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("child"))
            choices = {str(k): F.array(*[entry(kind, c) for own, kind, c in asked if own == k]) for k in {a[0] for a in asked}}
            which = F.try_element_at(F.create_map(*[x for k, v in choices.items() for x in (F.lit(k), v)]), F.col("prop").cast("string"))
            rows = level.select("shape", "focus", "prop", "value", F.explode(which).alias("c")).select("shape", "focus", "prop", "value", "c.*").distinct()
            rows = rows.join(failed.withColumn("failed", F.lit(1)), ["child", "value"], "left")
            rows = rows.groupBy("shape", "focus", "prop", "value", "kind").agg(F.count("*").alias("n"), F.count("failed").alias("failed"))
            tests = []
            for k, kind in {(a[0], a[1]) for a in asked}:
                name, bad = _LOGIC[kind]
                tests.append(((F.col("prop") == k) & (F.col("kind") == kind) & bad(F.col("n"), F.col("failed")), self.of(k, name, F.col("value"))))
            self.add(rows, tests)
        counted = [(k, p) for k, (i, p) in enumerate(self.props) if i in members and p.qualified]
        if counted:
            child = F.create_map(*[x for k, p in counted for x in (F.lit(k), F.lit(self.number[p.qualified]))])
            rows = level.filter(F.col("prop").isin(*[k for k, _ in counted])).distinct().withColumn("child", child[F.col("prop")])
            fits = rows.join(failed, ["child", "value"], "left_anti").groupBy("shape", "focus", "prop").agg(F.count("*").alias("fits"))
            every = self.every(focus.filter(F.col("shape").isin(*members))).filter(F.col("prop").isin(*[k for k, _ in counted]))
            rows = every.join(fits, ["shape", "focus", "prop"], "left").withColumn("fits", F.coalesce("fits", F.lit(0)))
            null, tests = F.lit(None).cast("string"), []
            for k, p in counted:
                if p.qualified_min is not None:
                    tests.append(((F.col("prop") == k) & (F.col("fits") < p.qualified_min), self.of(k, "QualifiedMinCount", null)))
                if p.qualified_max is not None:
                    tests.append(((F.col("prop") == k) & (F.col("fits") > p.qualified_max), self.of(k, "QualifiedMaxCount", null)))
            self.add(rows, tests)


def _ordered(value: Column) -> list[Column]:
    """What a literal is compared by: its kind, and a number or a text."""
    kind, form = datatype(value), text(value)
    time = F.when(kind.isin(t.XSD + "dateTime", t.XSD + "date"), F.unix_micros(form.try_cast("timestamp")).cast("double"))
    x = F.coalesce(number(value), time)
    plain = value.startswith('"') & (kind == t.XSD + "string")
    name = F.when(number(value).isNotNull(), "number").when(time.isNotNull(), F.regexp_extract(kind, "#(.*)$", 1)).when(plain, "text").otherwise("none")
    return [name.alias("kind"), x.alias("x"), F.when(plain, form).alias("y")]


def validate(facts: DataFrame, shapes: list[Shape]) -> DataFrame:
    """Findings of all shapes at their targets, one row each.

    The nodes of all target and value classes come from one scan of the types,
    the values of all predicates of a stratum from one scan and one join with the
    focus nodes; a further scan is made only for closed shapes, for paths of
    several steps and for predicates that values are compared with.

    What a nested shape finds is not reported itself, only that its constraint
    fails.  Shapes that lead back to themselves are an error.
    """
    spark = facts.sparkSession
    if not shapes:
        return spark.createDataFrame([], COLUMNS)
    depth, run = _depths(shapes), _Run(facts, shapes)
    tables, props = run.tables, run.props
    classes = sorted({s.target_class for s in shapes if s.target_class} | {p.cls for _, p in props if p.cls})
    members = _members(facts, classes, tables) if classes else None
    targets = tables.cut(_targets(facts, shapes, members), "targets")
    strata = [[i for i, s in enumerate(shapes) if depth[s.name] == d] for d in range(max(depth.values()) + 1)]
    # from the targets down: the nodes that each shape is asked about, and their values
    focus, values = targets, None
    if len(strata) == 1:
        values = tables.cut(_values(facts, focus, props), "values") if props else None
    else:
        asked, parts = [targets], []
        for own in reversed(strata):
            now = tables.cut(reduce(DataFrame.union, asked).filter(F.col("shape").isin(*own)).distinct(), "focus")
            here = [(k, i, p) for k, (i, p) in enumerate(props) if i in own]
            parts.append((now, None))
            if here:
                found = _values(facts, now, [(i, p) for _, i, p in here])
                back = F.array(*[F.lit(k) for k, _, _ in here])
                found = tables.cut(found.withColumn("prop", F.element_at(back, F.col("prop") + 1)), "values")
                parts[-1] = (now, found)
                below = {str(k): sorted({run.number[x] for x in _references(p)}) for k, _, p in here if _references(p)}
                if below:
                    asked.append(found.select(F.explode(_choose(F.col("prop").cast("string"), below)).alias("shape"), F.col("value").alias("focus")))
        focus = tables.cut(reduce(DataFrame.union, [f for f, _ in parts]), "focus")
        kept = [v for _, v in parts if v is not None]
        values = reduce(DataFrame.union, kept) if kept else None
    run.plain(focus, values, members)
    found = run.take()
    if len(strata) > 1:
        every, failed = [found], found.select(F.col("shape").alias("child"), F.col("focus").alias("value")).distinct()
        for (now, own_values), own in zip(reversed(parts), strata, strict=True):
            if own_values is not None and any(_references(p) for i, p in props if i in own):
                run.nested(own_values, own, now, failed)
                more = run.take()
                every.append(more)
                failed = tables.cut(failed.union(more.select(F.col("shape").alias("child"), F.col("focus").alias("value"))).distinct(), "failed")
        found = reduce(DataFrame.union, every).join(targets, ["shape", "focus"], "left_semi")
    return found.select(F.element_at(run.names, F.col("shape") + 1).alias("shape"), *[c.split()[0] for c in COLUMNS.split(", ")[1:]])


def validate_one(facts: DataFrame, shapes: list[Shape], name: str) -> DataFrame:
    """Findings of one shape, by its name; the others are there to be referred to."""
    if name not in {s.name for s in shapes}:
        raise ValueError(f"no shape {name}")
    bare = {"target_class": None, "target_nodes": (), "target_subjects_of": (), "target_objects_of": ()}
    return validate(facts, [s if s.name == name else Shape(**{**s.__dict__, **bare}) for s in shapes])


# shapes as quads


#: Fields with one value and their terms: plain texts and numbers, and those whose value is an IRI.
_PARTS = {
    "min_count": "minCount", "max_count": "maxCount", "pattern": "pattern", "message": "message", "min_length": "minLength", "max_length": "maxLength",
    "min_inclusive": "minInclusive", "max_inclusive": "maxInclusive", "min_exclusive": "minExclusive", "max_exclusive": "maxExclusive",
    "qualified_min": "qualifiedMinCount", "qualified_max": "qualifiedMaxCount",
}
_IRIS = {"datatype": "datatype", "cls": "class", "equals": "equals", "disjoint": "disjoint", "less_than": "lessThan", "less_than_or_equals": "lessThanOrEquals"}
_WHOLE = ("min_count", "max_count", "min_length", "max_length", "qualified_min", "qualified_max")
_LISTS = {"all_of": "and", "any_of": "or", "just_one_of": "xone"}
_EACH = {"node": "node", "none_of": "not"}
_STEPS = {"inverse": "inversePath", "star": "zeroOrMorePath", "plus": "oneOrMorePath", "maybe": "zeroOrOnePath"}


_READ = {
    *_PARTS.values(), *_IRIS.values(), *_LISTS.values(), *_EACH.values(), "severity", "nodeKind", "hasValue", "in", "uniqueLang", "qualifiedValueShape", "path", "property",
    "closed", "ignoredProperties", "targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf", "deactivated", "name", "description", "order", "group", "defaultValue",
}


def _iri(name: str) -> str:
    """Key of the node of a shape; names of shapes that were read from elsewhere are keys already."""
    return name if name.startswith(("<", "_:")) else f"<{t.BASE}shape/{name}>"


class _Writer:
    """Triples (subject, term, object) of a shape."""

    def __init__(self) -> None:
        self.said: list[tuple[str, str, str]] = []

    def listed(self, label: str, items: list[str]) -> str:
        """Key of a list of keys."""
        rest = f"<{t.RDF}nil>"
        for j in reversed(range(len(items))):
            node = f"_:{label}.{j}"
            self.said += [(node, t.RDF + "first", items[j]), (node, t.RDF + "rest", rest)]
            rest = node
        return rest

    def path(self, label: str, path: Path) -> str:
        if isinstance(path, str):
            return f"<{path}>"
        kind, *parts = path
        inner = [self.path(f"{label}.{j}p", x) for j, x in enumerate(parts)]
        if kind == "seq":
            return self.listed(label, inner)
        node = f"_:{label}.node"
        self.said.append((node, t.SH + ("alternativePath" if kind == "alt" else _STEPS[kind]), self.listed(label, inner) if kind == "alt" else inner[0]))
        return node

    def constraints(self, node: str, label: str, p: Property) -> None:
        add = lambda term, key: self.said.append((node, t.SH + term, key))
        for name, term in _PARTS.items():
            value = getattr(p, name)
            if value is not None:
                kind = "" if isinstance(value, str) else f"^^<{t.XSD}{'integer' if isinstance(value, int) else 'decimal'}>"
                quoted = str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
                add(term, f'"{quoted}"{kind}')
        for name, term in _IRIS.items():
            if getattr(p, name) is not None:
                add(term, f"<{getattr(p, name)}>")
        if p.severity != "Violation":
            add("severity", f"<{t.SH}{p.severity}>")
        if p.node_kind is not None:
            add("nodeKind", f"<{t.SH}{p.node_kind}>")
        if p.has_value is not None:
            add("hasValue", p.has_value)
        if p.one_of is not None:
            add("in", self.listed(f"{label}.in", list(p.one_of)))
        if p.unique_lang:
            add("uniqueLang", f'"true"^^<{t.XSD}boolean>')
        if p.qualified is not None:
            add("qualifiedValueShape", _iri(p.qualified))
        for name, term in _EACH.items():
            for x in getattr(p, name):
                add(term, _iri(x))
        for name, term in _LISTS.items():
            if getattr(p, name):
                add(term, self.listed(f"{label}.{term}", [_iri(x) for x in getattr(p, name)]))


def save(rows: DataFrame, shape: Shape) -> DataFrame:
    """``rows`` with the shape's quads in the shapes graph, in place of those of an earlier shape of this name.

    Constraints on the focus node itself are said of the shape; two properties
    that say such a thing with one term that takes one value are an error.
    """
    node, w = _iri(shape.name), _Writer()
    w.said.append((node, t.TYPE, f"<{t.SH}NodeShape>"))
    if shape.target_class:
        w.said.append((node, t.SH + "targetClass", f"<{shape.target_class}>"))
    w.said += [(node, t.SH + "targetNode", x) for x in shape.target_nodes]
    w.said += [(node, t.SH + term, f"<{x}>") for term, xs in (("targetSubjectsOf", shape.target_subjects_of), ("targetObjectsOf", shape.target_objects_of)) for x in xs]
    w.said.append((node, t.SH + "closed", f'"{str(shape.closed).lower()}"^^<{t.XSD}boolean>'))
    if shape.ignore_type:
        w.said.append((node, t.SH + "ignoredProperties", w.listed(f"{shape.name}-0.ignored", [f"<{t.TYPE}>"])))
    single: set[str] = set()
    for k, p in enumerate(shape.properties):
        label = f"{shape.name}-{k}"
        if p.path == SELF:
            once = [n for n in (*_PARTS, *_IRIS, "node_kind", "qualified") if getattr(p, n) is not None] + (["severity"] if p.severity != "Violation" else [])
            if single & set(once):
                raise ValueError(f"shape {shape.name}: two values of {', '.join(sorted(single & set(once)))} for the focus node")
            single |= set(once)
            w.constraints(node, label, p)
        else:
            w.said += [(node, t.SH + "property", f"_:{label}"), (f"_:{label}", t.SH + "path", w.path(f"{label}.path", p.path))]
            w.constraints(f"_:{label}", label, p)
    made = rows.sparkSession.createDataFrame(w.said, "sk string, p string, ok string")
    made = made.select(F.lit(t.SHAPES).alias("g"), "sk", t.iri_key(F.col("p")).alias("pk"), "ok")
    return remove(rows, shape.name).unionByName(of_keys(made))


def remove(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` without the quads of a shape, of its properties and of their lists."""
    own = (F.col("s") == f"{t.BASE}shape/{name}") | ((F.col("s_kind") == "bnode") & F.col("s").rlike(f"^\\Q{name}\\E-\\d+(\\.[\\w.]+)?$"))
    return rows.filter(~(F.col("g").eqNullSafe(F.lit(t.SHAPES)) & own))


class _Loader:
    """Shapes from the quads of a shapes graph, whoever wrote them."""

    def __init__(self, rows: list) -> None:
        self.said: dict[str, dict[str, list[tuple[str, str]]]] = {}
        for subject, p, key, form in rows:
            self.said.setdefault(subject, {}).setdefault(p, []).append((key, form))

    def get(self, node: str, term: str) -> list[tuple[str, str]]:
        return sorted(self.said.get(node, {}).get(term if ":" in term else t.SH + term, []), key=lambda x: (len(x[0]), x[0]))

    def items(self, node: str) -> list[str]:
        out, seen = [], set()
        while node in self.said and node not in seen:
            seen.add(node)
            out += [k for k, _ in self.get(node, t.RDF + "first")]
            node = next((k for k, _ in self.get(node, t.RDF + "rest")), "")
        return out

    def path(self, node: str) -> Path:
        if node.startswith("<"):
            return node[1:-1]
        for kind, term in _STEPS.items():
            if found := self.get(node, term):
                return (kind, self.path(found[0][0]))
        if found := self.get(node, "alternativePath"):
            return ("alt", *[self.path(x) for x in self.items(found[0][0])])
        parts = [self.path(x) for x in self.items(node)]
        if not parts:
            raise ValueError(f"no path: {node}")
        return ("seq", *parts) if len(parts) > 1 else parts[0]

    def name(self, node: str) -> str:
        own = f"<{t.BASE}shape/"
        return node[len(own) : -1] if node.startswith(own) else node

    def properties(self, node: str, path: Path) -> list[Property]:
        """The constraints said of a node; a term that takes one value but has more makes further ones."""
        said: list[tuple[str, object]] = []
        for field_, term in _PARTS.items():
            said += [(field_, int(x) if field_ in _WHOLE else x if field_ in ("pattern", "message") else float(x)) for _, x in self.get(node, term)]
        for field_, term in _IRIS.items():
            said += [(field_, x) for _, x in self.get(node, term)]
        said += [(f, x.removeprefix(t.SH)) for f, term in (("severity", "severity"), ("node_kind", "nodeKind")) for _, x in self.get(node, term)]
        said += [("has_value", k) for k, _ in self.get(node, "hasValue")] + [("one_of", tuple(self.items(k))) for k, _ in self.get(node, "in")]
        said += [("unique_lang", True) for _, x in self.get(node, "uniqueLang") if x == "true"]
        said += [("qualified", self.name(k)) for k, _ in self.get(node, "qualifiedValueShape")]
        for field_, term in _EACH.items():
            if found := self.get(node, term):
                said.append((field_, tuple(self.name(k) for k, _ in found)))
        for field_, term in _LISTS.items():
            said += [(field_, tuple(self.name(x) for x in self.items(k))) for k, _ in self.get(node, term)]
        out: list[dict] = [{}]
        for field_, value in said:
            place = next((x for x in out if field_ not in x), None)
            if place is None:
                out.append(place := {k: v for k, v in out[0].items() if k in ("severity", "message")})
            place[field_] = value
        return [Property(path, **x) for x in out if x or path != SELF]

    def shape(self, node: str) -> Shape:
        if own := self.get(node, "path"):
            props = self.properties(node, self.path(own[0][0]))
        else:
            props = [q for k, _ in self.get(node, "property") for q in self.properties(k, self.path(self.get(k, "path")[0][0]))]
            # a property shape may hold further ones for its values; those are asked as shapes of their own
            props += self.properties(node, SELF)
        types = {x for _, x in self.get(node, t.TYPE)}
        target = [x for _, x in self.get(node, "targetClass")]
        if types & {t.RDFS + "Class", t.OWL + "Class"} and node.startswith("<"):
            target.append(node[1:-1])
        listed = lambda term: tuple(x for _, x in self.get(node, term))
        return Shape(
            self.name(node), target[0] if target else None, props, closed=("true" in listed("closed")),
            ignore_type=any(f"<{t.TYPE}>" in self.items(k) for k, _ in self.get(node, "ignoredProperties")),
            target_nodes=tuple(k for k, _ in self.get(node, "targetNode")), target_subjects_of=listed("targetSubjectsOf"), target_objects_of=listed("targetObjectsOf"),
        )

    def shapes(self) -> list[Shape]:
        targets = [t.SH + x for x in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf")]
        found = {n for n, said in self.said.items() if any(x in said for x in targets) or any(x == t.SH + "NodeShape" for _, x in said.get(t.TYPE, []))}
        for node in list(self.said):
            found |= {k for term in (*_EACH.values(), "qualifiedValueShape") for k, _ in self.get(node, term)}
            found |= {x for term in _LISTS.values() for k, _ in self.get(node, term) for x in self.items(k)}
        found = {n for n in found if not any(x == "true" for _, x in self.get(n, "deactivated"))}
        self.check(found)
        return sorted((self.shape(n) for n in found), key=lambda s: s.name)

    def check(self, found: set[str]) -> None:
        """An error for a constraint that would be lost: terms that are not read, and properties of the values of a property."""
        parts = {k for n in found for k, _ in self.get(n, "property")}
        for node in sorted(found | parts):
            odd = sorted(p for p in self.said.get(node, {}) if p.startswith(t.SH) and p[len(t.SH) :] not in _READ)
            if self.get(node, "path") and self.get(node, "property"):
                odd.append(t.SH + "property")
            if any(x == "true" for k in parts for _, x in self.get(k, "deactivated")):
                odd.append(t.SH + "deactivated")
            if odd:
                raise ValueError(f"shape {node}: {', '.join(x[len(t.SH):] for x in odd)} is not read here")


def load(rows: DataFrame) -> list[Shape]:
    """The shapes of the shapes graph, in order of their names; shapes are few, whatever the data.

    Shapes that were written by hand are read too: blank labels may be any, and
    a shape without a name of its own is named by its label.  A target class
    beyond the first one of a shape is not read: such a shape is an error, and
    so is one with a constraint of a kind that is not evaluated.
    """
    said = rows.filter(F.col("g") == t.SHAPES).select(t.node_key(F.col("s"), F.col("s_kind")).alias("s"), "p", "o_key", "o").collect()
    for r in said:
        if r["p"] == t.SH + "targetClass" and sum(x["s"] == r["s"] and x["p"] == r["p"] for x in said) > 1:
            raise ValueError(f"more than one target class: {r['s']}")
    return _Loader([tuple(r) for r in said]).shapes()


def report(findings: DataFrame, shapes: list[Shape]) -> DataFrame:
    """One row: conforms, shapes, findings, nodes."""
    return findings.agg((F.count("*") == 0).alias("conforms"), F.lit(len(shapes)).cast("long").alias("shapes"), F.count("*").alias("findings"), F.countDistinct("focus").alias("nodes"))
