"""Forward chaining by rules over triples of term keys, round by round.

``facts`` has s, p, o as N-Triples keys.  A round derives what the facts of its
start allow, joining last round's new facts with the known ones; a conclusion's
first derivation, by rule and then premises, is its provenance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..storage import Growing, KeyTables, joinable
from .algebra import text

_TYPE, _SUB, _SUBP = t.TYPE, t.RDFS + "subClassOf", t.RDFS + "subPropertyOf"
_SAME = t.OWL + "sameAs"


@dataclass(frozen=True)
class Rule:
    """Premises and conclusion; parts are variables (``?x``) or IRIs."""

    name: str
    premises: tuple[tuple[str, str, str], ...]
    conclusion: tuple[str, str, str]


# fixed values: the published entailment rules in the order that decides provenance
RULES = (
    Rule("subclass-transitive", (("?a", _SUB, "?b"), ("?b", _SUB, "?c")), ("?a", _SUB, "?c")),
    Rule("subclass-instance", (("?x", _TYPE, "?a"), ("?a", _SUB, "?b")), ("?x", _TYPE, "?b")),
    Rule("subproperty-transitive", (("?p", _SUBP, "?q"), ("?q", _SUBP, "?r")), ("?p", _SUBP, "?r")),
    Rule("subproperty-value", (("?x", "?p", "?y"), ("?p", _SUBP, "?q")), ("?x", "?q", "?y")),
    Rule("domain", (("?p", t.RDFS + "domain", "?c"), ("?x", "?p", "?y")), ("?x", _TYPE, "?c")),
    Rule("range", (("?p", t.RDFS + "range", "?c"), ("?x", "?p", "?y")), ("?y", _TYPE, "?c")),
    Rule("inverse", (("?p", t.OWL + "inverseOf", "?q"), ("?x", "?p", "?y")), ("?y", "?q", "?x")),
    Rule("inverse-reverse", (("?p", t.OWL + "inverseOf", "?q"), ("?x", "?q", "?y")), ("?y", "?p", "?x")),
    Rule("transitive", (("?p", _TYPE, t.OWL + "TransitiveProperty"), ("?x", "?p", "?y"), ("?y", "?p", "?z")), ("?x", "?p", "?z")),
    Rule("symmetric", (("?p", _TYPE, t.OWL + "SymmetricProperty"), ("?x", "?p", "?y")), ("?y", "?p", "?x")),
    Rule("equivalent-class", (("?a", t.OWL + "equivalentClass", "?b"),), ("?a", _SUB, "?b")),
    Rule("equivalent-class-reverse", (("?a", t.OWL + "equivalentClass", "?b"),), ("?b", _SUB, "?a")),
    Rule("equivalent-property", (("?p", t.OWL + "equivalentProperty", "?q"),), ("?p", _SUBP, "?q")),
    Rule("equivalent-property-reverse", (("?p", t.OWL + "equivalentProperty", "?q"),), ("?q", _SUBP, "?p")),
    Rule("same-symmetric", (("?x", _SAME, "?y"),), ("?y", _SAME, "?x")),
    Rule("same-subject", (("?x", _SAME, "?y"), ("?x", "?p", "?z")), ("?y", "?p", "?z")),
    Rule("same-object", (("?x", _SAME, "?y"), ("?z", "?p", "?x")), ("?z", "?p", "?y")),
)
PROFILES = {"none": RULES[:0], "rdfs": RULES[:6], "rl-lite": RULES}
MAX_ROUNDS, MAX_DERIVED = 20, 1_000_000
#: Facts of a premise (schema, mostly) are broadcast up to this many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 4 << 20


def _key(part: str) -> str:
    return part if part.startswith("?") else f"<{part}>"


def _premise(facts: DataFrame, premise: tuple[str, str, str], n: int) -> DataFrame:
    """Bindings of one premise, with the fact's text as ``f<n>``."""
    bound: dict[str, Column] = {}
    for column, part in zip(("s", "p", "o"), premise, strict=True):
        if not part.startswith("?"):
            facts = facts.filter(F.col(column) == _key(part))
        elif part in bound:
            facts = facts.filter(bound[part] == F.col(column))
        else:
            bound[part] = F.col(column)
    return facts.select(*[c.alias(v[1:]) for v, c in bound.items()], F.concat_ws(" ", "s", "p", "o").alias(f"f{n}"))


def _vocabulary(facts: DataFrame, rules: tuple[Rule, ...]) -> dict[tuple[str, str], int]:
    """Bytes of the facts with each of the rules' own predicates (and, for types, classes), if there are any."""
    asked = {(_key(p), _key(o)) if not o.startswith("?") else (_key(p), "") for r in rules for _, p, o in r.premises if not p.startswith("?")}
    predicates = sorted({p for p, _ in asked})
    classes = sorted({o for _, o in asked if o})
    named = F.when(F.col("o").isin(classes), F.col("o")).otherwise("").alias("o")
    size = F.octet_length("s") + F.octet_length("p") + F.octet_length("o")
    rows = facts.filter(F.col("p").isin(predicates)).groupBy("p", named).agg(F.sum(size).alias("bytes"))
    found: dict[tuple[str, str], int] = {}
    for r in rows.collect():  # bounded by the rules
        for key in {(r["p"], ""), (r["p"], r["o"])}:
            found[key] = found.get(key, 0) + r["bytes"]
    return found


def _usable(premise: tuple[str, str, str], vocabulary: dict[tuple[str, str], int]) -> int | None:
    """Bytes of the facts that a premise can match, None if there is no such fact; 0 if the predicate is open."""
    _, p, o = premise
    return 0 if p.startswith("?") else vocabulary.get((_key(p), "" if o.startswith("?") else _key(o)))


def candidates(known: DataFrame, delta: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """All conclusions of one round with at least one new premise: s, p, o, why."""
    everywhere, fresh = _vocabulary(known, rules), _vocabulary(delta, rules)
    made = []
    for index, rule in enumerate(rules):
        if not all(_usable(x, everywhere) is not None for x in rule.premises):
            continue
        for new in range(len(rule.premises)):
            if _usable(rule.premises[new], fresh) is None:
                continue
            parts = []
            for i, x in enumerate(rule.premises):
                part = _premise(delta if i == new else known, x, i)
                size = _usable(x, fresh if i == new else everywhere)
                parts.append(part.hint("broadcast" if 0 < size <= BROADCAST_BYTES else "merge"))
            joined = reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns]), parts)
            s, p, o = (F.col(x[1:]) if x.startswith("?") else F.lit(_key(x)) for x in rule.conclusion)
            premises = [F.col(f"f{i}") for i in range(len(parts))] + [F.lit("")] * (3 - len(parts))
            why = F.struct(F.lit(index).alias("rule"), *[c.alias(f"f{i}") for i, c in enumerate(premises)])
            made.append(joined.select(s.alias("s"), p.alias("p"), o.alias("o"), why.alias("why")))
    if not made:
        return None
    rows = reduce(DataFrame.union, made)
    return rows.filter(F.col("s").startswith("<") & F.col("p").startswith("<") & ~F.col("s").startswith("<<"))


@dataclass
class Inference:
    derivations: DataFrame  # s, p, o, rule, f0, f1, f2, round
    rounds: int
    reached_fixed_point: bool
    hit_cap: bool


def materialise(facts: DataFrame, profile: str | tuple[Rule, ...] = "rl-lite", max_rounds: int = MAX_ROUNDS, max_derived: int | None = None) -> Inference:
    """Derive to a fixed point, or until a limit is reached.

    The last, empty round counts.  There is no cap on the derivations unless one
    is given (``MAX_DERIVED`` is that of the published service); it keeps the
    first derivations of the round in which it is reached, by rule and premises.
    """
    rules = PROFILES[profile] if isinstance(profile, str) else profile
    tables = KeyTables(facts.sparkSession, "inference")
    given = delta = tables.cut(facts.select("s", "p", "o").distinct(), "facts")
    nothing = facts.sparkSession.createDataFrame([], "s string, p string, o string, rule string, f0 string, f1 string, f2 string, round int")
    derived = Growing(tables, "derived", nothing.schema)
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else None
    total = 0
    for number in range(1, max_rounds + 1):
        so_far = derived.read() if derived.parts else nothing
        known = joinable(given.union(so_far.select("s", "p", "o")), tables.size + derived.size)
        made = candidates(known, delta, rules) if rules else None
        if made is None:
            return Inference(so_far, number, True, False)
        first = made.groupBy("s", "p", "o").agg(F.min("why").alias("why")).join(known, ["s", "p", "o"], "left_anti")
        rows = first.select("s", "p", "o", F.element_at(names, F.col("why.rule") + 1).alias("rule"), "why.f0", "why.f1", "why.f2", F.lit(number).alias("round"), F.col("why.rule").alias("at"))
        if max_derived is not None:
            rows = tables.cut(rows, "round")
            n = rows.count()
            if n and total + n >= max_derived:
                derived.add(rows.orderBy("at", "f0", "f1", "f2", "s", "p", "o").limit(max_derived - total))
                return Inference(derived.read(), number, False, True)
            total += n
        fresh = derived.add(rows)
        if fresh.isEmpty():
            return Inference(so_far, number, True, False)
        delta = fresh.select("s", "p", "o")
    return Inference(derived.read() if derived.parts else nothing, max_rounds, False, False)


def facts_of(rows: DataFrame) -> DataFrame:
    """Triples of the ontology, data and vocabulary graphs as keys."""
    asked = F.col("g").isin(t.ONTOLOGY, t.DATA) | F.col("g").startswith(t.VOCAB)
    return rows.filter(asked).select(t.node_key(F.col("s"), F.col("s_kind")).alias("s"), t.iri_key(F.col("p")).alias("p"), F.col("o_key").alias("o")).distinct()


def explain(derivations: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Rule and premises of one derived triple."""
    return derivations.filter((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o))


def explain_labelled(derivations: DataFrame, rows: DataFrame) -> DataFrame:
    """(s, p, o, rule, premises): each derivation with its premises in words, by the labels in ``rows``."""
    names = t.labels(rows).select(t.iri_key(F.col("s")).alias("key"), "label")
    parts = derivations.select("s", "p", "o", "rule", F.posexplode(F.array("f0", "f1", "f2")).alias("place", "fact")).filter("fact <> ''")
    for k, pattern in enumerate((r"^(\S+) ", r"^\S+ (\S+) ", r"(?s)^\S+ \S+ (.*)$")):
        named = names.select(F.col("key").alias("k_"), F.col("label").alias("label_"))
        key = F.regexp_extract("fact", pattern, 1)
        parts = parts.withColumn("k_", key).join(named, "k_", "left")
        word = F.coalesce("label_", F.when(F.col("k_").startswith("<"), t.local_name(text(F.col("k_")))).otherwise(text(F.col("k_"))))
        parts = parts.withColumn(f"w{k}", word).drop("k_", "label_")
    told = F.struct("place", F.concat_ws(" ", "w0", "w1", "w2").alias("words"))
    grouped = parts.groupBy("s", "p", "o", "rule").agg(F.sort_array(F.collect_list(told)).alias("told"))
    return grouped.select("s", "p", "o", "rule", F.transform("told", lambda x: x["words"]).alias("premises"))


def records(derivations: DataFrame) -> DataFrame:
    """Derivations as record quads: what is stated, by which rule, from what (subject, p, text)."""
    record = F.concat(F.lit("urn:kg:derivation/"), F.substring(F.sha2(F.concat_ws(" ", "s", "p", "o"), 256), 1, 26))
    fact = lambda *c: F.concat(F.lit("<<( "), F.concat_ws(" ", *c), F.lit(" )>>"))
    pair = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o_key"))
    parts = [pair(t.REIFIES, fact("s", "p", "o")), pair(t.ONT + "rule", F.concat(F.lit('"'), "rule", F.lit('"')))]
    parts += [pair(t.ONT + "premise", F.when(F.col(f"f{i}") != "", fact(f"f{i}"))) for i in range(3)]
    return derivations.select(record.alias("s"), F.explode(F.array(*parts)).alias("q")).select("s", "q.*").filter("o_key is not null").distinct()
