"""Pattern matching over quads as DataFrame operators.

A solution set is a DataFrame with one string column per variable, which holds
the key of the term bound to it (N-Triples text), null where it is unbound.
Patterns are tuples (s, p, o) or (s, p, o, g); a term that starts with ``?`` is
a variable, any other one a key such as ``<iri>`` or ``"text"``.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import terms as t

Pattern = tuple[str, ...]


def iri(value: str) -> str:
    return f"<{value}>"


def scan(rows: DataFrame, s: str | None = None, p: str | None = None, o_key: str | None = None, g: str | None = None) -> DataFrame:
    """Quads that match the given parts; the filters reach the Parquet scan."""
    for column, value in (("s", s), ("p", p), ("o_key", o_key), ("g", g)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def counts(rows: DataFrame) -> DataFrame:
    """Quads of each graph, the default graph as null."""
    return rows.groupBy("g").agg(F.count("*").alias("n"))


def graphs(rows: DataFrame) -> DataFrame:
    """Named graphs that hold quads."""
    return rows.filter("g is not null").select("g").distinct()


def contained(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The quads of ``asked`` that are in ``rows``."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("g", "s", "s_kind", "p", "o_key")]
    return asked.alias("a").join(rows.alias("b"), reduce(Column.__and__, same), "left_semi")


def match(rows: DataFrame, pattern: Pattern) -> DataFrame:
    """Solutions of one pattern.  Without a fourth part only the default graph counts
    if it is named ``None``; by default any graph does (pass ``?g`` to bind it)."""
    values = {"s": t.node_key(F.col("s"), F.col("s_kind")), "p": t.iri_key(F.col("p")), "o": F.col("o_key"), "g": t.iri_key(F.col("g"))}
    bound: dict[str, Column] = {}
    for part, term in zip("spog", pattern, strict=False):
        if term is None:
            rows = rows.filter(F.col("g").isNull())
        elif term.startswith("?"):
            if part == "g":
                rows = rows.filter("g is not null")
            if term[1:] in bound:
                rows = rows.filter(bound[term[1:]] == values[part])
            else:
                bound[term[1:]] = values[part]
        elif part == "o":
            rows = rows.filter(F.col("o_key") == term)
        else:
            # on the plain column, so that the filter is pushed into the scan
            rows = rows.filter(F.col(part) == term.removeprefix("_:").strip("<>"))
    return rows.select(*[c.alias(v) for v, c in bound.items()])


def bgp(rows: DataFrame, patterns: list[Pattern], stats: dict[str, int] | None = None) -> DataFrame:
    """Join of patterns on their shared variables.

    Patterns with more constants come first, then those whose predicate has
    fewer quads by ``stats``, and each next one shares a variable with those
    before it, so no product is formed unless the patterns ask for one.
    """

    def rank(p: Pattern) -> tuple[int, int]:
        free = sum(x is not None and x.startswith("?") for x in p[:3])
        return free, (stats or {}).get(p[1], 1 << 60)

    left = sorted(patterns, key=rank)
    out, seen = None, set()
    while left:
        nxt = next((p for p in left if seen & {x for x in p if x and x.startswith("?")}), left[0])
        left.remove(nxt)
        solutions = match(rows, nxt)
        out = solutions if out is None else join(out, solutions)
        seen |= {x for x in nxt if x and x.startswith("?")}
    return out


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def join(a: DataFrame, b: DataFrame, unbound: tuple[str, ...] = ()) -> DataFrame:
    """Compatible merge.  ``unbound`` names shared variables that may be null on
    either side; an unbound variable is compatible with anything."""
    shared = _shared(a, b)
    if not shared:
        warnings.warn("patterns without a shared variable: every pair of solutions is formed", stacklevel=2)
        return a.crossJoin(b)
    if not unbound:
        return a.join(b, shared)
    rows = _agreeing(a, b, shared, unbound)
    return rows.select(*_filled(a, shared, unbound), *[c for c in b.columns if c not in shared])


def _copied(b: DataFrame, shared: list[str]) -> DataFrame:
    return b.select(*[F.col(c).alias(f"{c}__" if c in shared else c) for c in b.columns])


def _filled(a: DataFrame, shared: list[str], unbound: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.col(c), F.col(f"{c}__")).alias(c) if c in unbound and c in shared else F.col(c) for c in a.columns]


def _agreeing(a: DataFrame, b: DataFrame, shared: list[str], unbound: tuple[str, ...], some: bool = False) -> DataFrame:
    """Rows of ``a`` with each row of ``b`` that agrees in the variables both bind; b's copies are named ``<name>__``.

    A row of ``a`` is given once for every set of variables that a row of ``b``
    may bind, and the other way round.  Two rows then meet under the pair of sets
    that they have, and there they are joined on the variables in both: one
    equi-join, whatever is bound.  ``some`` asks for a variable that both bind.
    """
    b, free = _copied(b, shared), [c for c in shared if c in unbound]
    fixed = [F.col(c) == F.col(f"{c}__") for c in shared if c not in free]
    if not free:
        return a.join(b, reduce(Column.__and__, fixed))
    binds = lambda names: reduce(Column.__add__, [F.when(F.col(c).isNull(), 0).otherwise(1 << i) for i, c in enumerate(names)])
    every = F.explode(F.array(*[F.lit(x) for x in range(1 << len(free))]))

    def keyed(rows: DataFrame, names: list[str], own: str, other: str, mark: str) -> DataFrame:
        rows = rows.withColumn(own, binds(names)).withColumn(other, every)
        both = F.col(own).bitwiseAND(F.col(other))
        if some and not fixed:
            rows = rows.filter(both != 0)
        return rows.withColumns({f"{mark}{i}_": F.when(F.getbit(both, F.lit(i)) == 1, F.col(c)).otherwise("") for i, c in enumerate(names)})

    left = keyed(a, free, "has_a_", "asks_b_", "ka")
    right = keyed(b, [f"{c}__" for c in free], "has_b_", "asks_a_", "kb")
    meet = [F.col("has_a_") == F.col("asks_a_"), F.col("asks_b_") == F.col("has_b_"), *[F.col(f"ka{i}_") == F.col(f"kb{i}_") for i in range(len(free))]]
    return left.join(right, reduce(Column.__and__, [*meet, *fixed])).select(*a.columns, *b.columns)


def _without(a: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``a`` that agree with none of ``found`` in ``names``, where null agrees with null."""
    found = found.select(*[F.col(c).alias(f"{c}__") for c in names]).distinct()
    return a.join(found, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in names]), "left_anti")


def optional(a: DataFrame, b: DataFrame, condition: Column | None = None, unbound: tuple[str, ...] = ()) -> DataFrame:
    """Left join; a filter inside the optional part belongs to ``condition``.

    ``unbound`` names shared variables that may be null on either side; they
    take the value of the side that has one.
    """
    shared = _shared(a, b)
    more = [c for c in b.columns if c not in shared]
    if not set(shared) & set(unbound):
        on = reduce(Column.__and__, [F.col(c) == F.col(f"{c}__") for c in shared], F.lit(True))
        return a.join(_copied(b, shared), on if condition is None else on & condition, "left").select(*a.columns, *more)
    rows = _agreeing(a, b, shared, unbound)
    rows = rows if condition is None else rows.filter(condition)
    # equal rows have the same partners, so a row is alone if none like it is among those that have one
    alone = _without(a, rows, a.columns).select("*", *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in more])
    return rows.select(*_filled(a, shared, unbound), *more).unionByName(alone)


def union(*frames: DataFrame) -> DataFrame:
    """Bag union; variables that a branch lacks are unbound there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def minus(a: DataFrame, b: DataFrame, unbound: tuple[str, ...] = ()) -> DataFrame:
    """Solutions of ``a`` that agree with none of ``b`` in the variables both bind.

    Without a shared variable all stay; so does, where ``unbound`` names shared
    variables that may be null, a solution that has none in common with another.
    """
    shared = _shared(a, b)
    if not shared:
        return a
    if not set(shared) & set(unbound):
        return a.join(b, shared, "left_anti")
    pairs = _agreeing(a.select(*shared).distinct(), b.select(*shared).distinct(), shared, unbound, some=True)
    return _without(a, pairs, shared)


def exists(a: DataFrame, b: DataFrame, negate: bool = False) -> DataFrame:
    """Solutions of ``a`` with a partner in ``b``; without a shared variable any solution of ``b`` is one."""
    how, shared = "left_anti" if negate else "left_semi", _shared(a, b)
    if not shared:
        return a.join(F.broadcast(b.select(F.lit(True).alias("found__")).limit(1)), F.lit(True), how)
    return a.join(b, shared, how)


def values(spark, names: list[str], rows: list[tuple]) -> DataFrame:
    """An inline table; None stands for UNDEF."""
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def text(key: Column) -> Column:
    """Lexical form, IRI or blank label of a key."""
    return F.coalesce(S._text(key), F.regexp_extract(key, "^_:(.*)$", 1))


def language(key: Column) -> Column:
    return S._lang(key)


def datatype(key: Column) -> Column:
    return S._datatype(key)


def number(key: Column) -> Column:
    """Value of a numeric literal, null for any other term."""
    return F.when(datatype(key).isin(*[t.XSD + n for n in (*S.INTEGERS, *S.NUMERIC)]), S._text(key).try_cast("double"))


equal = S.equal


def order_key(key: Column) -> list[Column]:
    """Sort columns: unbound, blank nodes, IRIs, literals; numbers by value."""
    rank = F.when(key.isNull(), 0).when(key.startswith("_:"), 1).when(key.startswith("<"), 2).otherwise(3)
    return [rank, number(key), key]


def sum_(key: Column) -> Column:
    """SUM of a group: of the widest datatype in it, 0 of no value, null if any value is no number."""
    rank, wrong = F.max(S.numeric_rank(key)), F.count_if(key.isNotNull() & S.numeric_rank(key).isNull())
    exact, wide = F.sum(F.trim(S.text(key)).try_cast("decimal(28,8)")), F.sum(S.number(key))
    total = F.when(rank == 1, S.integer(exact)).when(rank == 2, S.decimal(exact)).when(rank == 3, S.double(wide.cast("float"), "float")).when(rank == 4, S.double(wide))
    return F.when(wrong > 0, F.lit(None).cast("string")).otherwise(F.coalesce(total, S.typed(F.lit("0"), "integer")))


def avg(key: Column) -> Column:
    """AVG of a group: a decimal of integers and decimals, 0 of no value, null if any value is no number."""
    rank, wrong = F.max(S.numeric_rank(key)), F.count_if(key.isNotNull() & S.numeric_rank(key).isNull())
    exact, wide = F.avg(F.trim(S.text(key)).try_cast("decimal(28,8)")), F.avg(S.number(key))
    mean = F.when(rank <= 2, S.decimal(exact)).when(rank == 3, S.double(wide.cast("float"), "float")).when(rank == 4, S.double(wide))
    return F.when(wrong > 0, F.lit(None).cast("string")).otherwise(F.coalesce(mean, S.typed(F.lit("0"), "integer")))


def sample(key: Column) -> Column:
    """SAMPLE: one of the values, the smallest key, so that reruns agree."""
    return F.min(key)


def least(key: Column) -> Column:
    """MIN by the order of ``order_key``."""
    return F.min(F.when(key.isNotNull(), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_key(key))]))).getField("k2")


def most(key: Column) -> Column:
    """MAX by the order of ``order_key``."""
    return F.max(F.when(key.isNotNull(), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_key(key))]))).getField("k2")


def dataset(rows: DataFrame, default: list[str], named: list[str] = ()) -> DataFrame:
    """The quads that a query sees with FROM and FROM NAMED: the default graph is the
    merge of ``default``, and only ``named`` can be matched by a fourth part."""
    merged = t.as_set(rows.filter(F.col("g").isin(*default)).withColumn("g", F.lit(None).cast("string"))) if default else rows.limit(0)
    return merged.unionByName(rows.filter(F.col("g").isin(*named))) if named else merged


def construct(solutions: DataFrame, template: list[Pattern], g: str | None = None) -> DataFrame:
    """Triples (s, p, o keys) of a template, as a set; ill-formed ones are left out."""
    term = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    made = F.explode(F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template]))
    rows = solutions.select(made.alias("x")).select("x.*")
    sound = F.col("s").isNotNull() & F.col("o").isNotNull() & F.col("p").startswith("<") & ~F.col("s").startswith('"')
    return rows.filter(sound).distinct()


def quoted(rows: DataFrame) -> DataFrame:
    """Solutions of a quoted-triple pattern: reifier, property and the three parts."""
    found = rows.filter("o_kind = 'triple'")
    return found.select(t.node_key(F.col("s"), F.col("s_kind")).alias("r"), t.iri_key(F.col("p")).alias("via"), t.iri_key(F.col("o_triple.s")).alias("s"), t.iri_key(F.col("o_triple.p")).alias("p"), F.col("o_triple.o_key").alias("o"))


def capped(solutions: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first ``most`` rows (a result page), and whether there were more."""
    return solutions.limit(most), solutions.limit(most + 1).count() > most


def labelled(solutions: DataFrame, variable: str, rows: DataFrame) -> DataFrame:
    """``variable`` rendered as ``iri (label)`` where it has a label."""
    names = t.labels(rows).select(t.iri_key(F.col("s")).alias(variable), F.col("label").alias("label_"))
    shown = F.when(F.col("label_").isNotNull(), F.concat(text(F.col(variable)), F.lit(" ("), "label_", F.lit(")"))).otherwise(text(F.col(variable)))
    return solutions.join(names, variable, "left").withColumn(variable, shown).drop("label_")


def encode(key: Column) -> Column:
    """A binding in the SPARQL results JSON form."""
    kind = F.when(key.startswith("<<"), "triple").when(key.startswith("<"), "uri").when(key.startswith("_:"), "bnode").otherwise("literal")
    lang = F.nullif(language(key), F.lit(""))
    dt = F.when(lang.isNull() & (datatype(key) != t.XSD + "string"), datatype(key))
    return F.when(key.isNotNull(), F.to_json(F.struct(kind.alias("type"), text(key).alias("value"), lang.alias("xml:lang"), dt.alias("datatype"))))
