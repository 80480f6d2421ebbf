"""Inference over classes of equal IRIs instead of their pairs.

IRIs that ``owl:sameAs`` joins are one class, and facts are kept about its
smallest member only.  The rules then run over these facts; what they find to be
the same is merged, and so on.  A class of n members costs n rows, where its pairs
and what the rules say of each member would be n * n and more; they are made when
they are asked for, for the rows asked for.

The rules replace equal terms as subjects and objects, not as predicates.  A class
with a term that is used as a property is therefore left to the rules, as are
blank nodes and literals, which the rules treat in one direction only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..storage import KeyTables
from . import inference as I
from .fixpoint import components

_SAME = f"<{t.OWL}sameAs>"
#: What makes its subject a property, and its object too.
_OF_PROPERTIES = [f"<{x}>" for x in (t.RDFS + "subPropertyOf", t.OWL + "inverseOf", t.OWL + "equivalentProperty")]
_BY_PROPERTIES = [f"<{x}>" for x in (t.RDFS + "domain", t.RDFS + "range")]
_KINDS = [f"<{t.OWL}{x}>" for x in ("TransitiveProperty", "SymmetricProperty")]


def _properties(facts: DataFrame) -> DataFrame:
    """(node) of the terms that are used as properties, or that the schema speaks of as such."""
    said = F.col("p").isin(_OF_PROPERTIES)
    own = F.array(
        F.col("p"), F.when(said | F.col("p").isin(_BY_PROPERTIES) | ((F.col("p") == f"<{t.TYPE}>") & F.col("o").isin(_KINDS)), F.col("s")), F.when(said, F.col("o")),
    )
    return facts.select(F.explode(F.array_compact(own)).alias("node")).distinct()


def _replaced(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """Facts about the smallest members, without those that say that a class is one."""
    for end in ("s", "o"):
        names = classes.select(F.col("node").alias(end), F.col("component").alias("own_"))
        columns = [F.coalesce("own_", end).alias(c) if c == end else F.col(c) for c in ("s", "p", "o")]
        facts = facts.join(names, end, "left").select(*columns)
    inside = facts.join(classes.select(F.col("component").alias("s"), F.col("component").alias("o"), F.lit(_SAME).alias("p")).distinct(), ["s", "p", "o"], "left_anti")
    return inside.select("s", "p", "o").distinct()


@dataclass
class Collapsed:
    """What holds: ``facts`` (s, p, o) about the smallest members, ``classes`` (node, component) of two members or more, and
    ``others``, the given facts whose subject is no IRI: of such a subject the rules derive nothing, nor do classes."""

    facts: DataFrame
    classes: DataFrame
    others: DataFrame

    def _members(self, end: str) -> DataFrame:
        return self.classes.select(F.col("component").alias(end), F.col("node").alias("own_"))

    def _expanded(self, rows: DataFrame) -> DataFrame:
        for end in ("s", "o"):
            columns = [F.coalesce("own_", end).alias(c) if c == end else F.col(c) for c in ("s", "p", "o")]
            rows = rows.join(self._members(end), end, "left").select(*columns)
        return rows

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """The facts (s, p, o) with the given parts, as the rules would give them; only what matches is expanded."""
        given = [(end, key) for end, key in (("s", s), ("o", o)) if key is not None]
        rows, pairs = self.facts.filter(F.col("s").startswith("<")), self.classes.select(F.col("node").alias("s"), F.lit(_SAME).alias("p"), "component")
        if p is not None:
            rows, pairs = rows.filter(F.col("p") == p), pairs.filter(F.col("p") == p)
        names = dict(given)
        for end, key in given:
            known = self.classes.filter(F.col("node") == key).select("component").first()
            own = known["component"] if known else key
            rows = rows.filter(F.col(end) == own)
            pairs = pairs.filter(F.col("component") == own)
        pairs = pairs.join(self.classes.select(F.col("node").alias("o"), "component"), "component").select("s", "p", "o")
        others = self.others if p is None else self.others.filter(F.col("p") == p)
        rows = self._expanded(rows).union(pairs).union(others)
        for end, key in names.items():
            rows = rows.filter(F.col(end) == key)
        return rows.distinct()

    def expand(self) -> DataFrame:
        """All that holds, pair by pair."""
        return self.match()


def materialise(facts: DataFrame, profile: str | tuple[I.Rule, ...] = "rl-lite") -> Collapsed:
    """All that the rules of a profile derive from ``facts``, and the facts themselves, by classes of equal IRIs.

    With a profile that has no rule for equal terms, nothing is merged.
    """
    rules = I.PROFILES[profile] if isinstance(profile, str) else profile
    tables = KeyTables(facts.sparkSession, "same-as")
    known = tables.cut(facts.select("s", "p", "o").distinct(), "facts")
    others = known.filter(~F.col("s").startswith("<"))
    merging = {"same-symmetric", "same-subject", "same-object"} <= {r.name for r in rules}
    classes = known.select(F.col("s").alias("node"), F.col("s").alias("component")).limit(0)
    while True:
        if merging:
            iris = F.col("s").startswith("<") & ~F.col("s").startswith("<<") & F.col("o").startswith("<") & ~F.col("o").startswith("<<")
            edges = known.filter((F.col("p") == _SAME) & iris & (F.col("s") != F.col("o"))).select(F.col("s").alias("a"), F.col("o").alias("b"))
            found = components(edges)
            # a class with a property in it stays as it is
            kept = found.join(_properties(known), "node", "left_semi").select("component").distinct()
            found = tables.cut(found.join(kept, "component", "left_anti").select("node", "component"), "found")
            # members of what was merged before follow their class
            older = classes.withColumnRenamed("component", "mid").join(found.withColumnRenamed("node", "mid"), "mid", "left")
            older = older.select("node", F.coalesce("component", "mid").alias("component"))
            classes = tables.cut(older.union(found.join(older.select("node"), "node", "left_anti")), "classes")
            known = tables.cut(_replaced(known, classes), "replaced")
        done = I.materialise(known, rules)
        if not done.reached_fixed_point:
            raise RuntimeError(f"inference stopped at a limit after {done.rounds} rounds")
        whole = tables.cut(known.union(done.derivations.select("s", "p", "o")), "whole")
        if not merging:
            return Collapsed(whole, classes, others)
        merged = _properties(whole).join(classes.select(F.col("component").alias("node")), "node", "left_semi")
        if not merged.isEmpty():  # a member of a class became a property: only the rules themselves are right for it
            plain = I.materialise(facts, rules)
            every = facts.select("s", "p", "o").union(plain.derivations.select("s", "p", "o")).distinct()
            return Collapsed(tables.cut(every, "every"), classes.limit(0), others)
        more = whole.filter((F.col("p") == _SAME) & F.col("s").startswith("<") & F.col("o").startswith("<") & (F.col("s") != F.col("o")))
        more = more.join(_properties(whole).withColumnRenamed("node", "s"), "s", "left_anti").join(_properties(whole).withColumnRenamed("node", "o"), "o", "left_anti")
        # what a class of properties says of its own members was there before
        fresh = more.join(known, ["s", "p", "o"], "left_anti")
        if fresh.isEmpty():
            return Collapsed(whole, classes, others)
        known = whole

