"""Scalar functions of SPARQL 1.1 over term keys, as Spark columns.

An argument is a column of keys (N-Triples text: ``<iri>``, ``_:label``,
``"text"``, ``"text"@lang``, ``"text"^^<datatype>``, ``<<( s p o )>>``), and so
is a result that is a term.  Tests return plain booleans, which ``boolean``
turns into terms.  An error of SPARQL is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as t

#: Numeric datatypes; the further one stands, the wider, and the wider of two operands decides the result.
NUMERIC = ("integer", "decimal", "float", "double")
INTEGERS = (
    "integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger",
    "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
)
_DATETIME = r"^(-?\d{4,})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?)(Z|[+-]\d{2}:\d{2})?$"
_DOUBLE = r"^\s*([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)\s*$"
_DECIMAL = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.element_at(F.transform(F.array(value), lambda v: fn(v)), 1)


class Term:
    """Parts of a key that has been taken apart once: key, text, lang, datatype, rank and number."""

    def __init__(self, parts: Column) -> None:
        self.key, self.text, self.lang, self.datatype, self.rank, self.number = (parts[n] for n in ("k", "t", "l", "d", "r", "n"))
        self.literal = self.key.startswith('"')

    def has(self, *names: str) -> Column:
        return self.datatype.isin(*[t.XSD + n for n in names])

    @property
    def plain(self) -> Column:
        return self.literal & self.datatype.isin(t.XSD + "string", t.RDF + "langString")


def _open(fn, *xs: Column) -> Column:
    """``fn`` of the terms that the keys ``xs`` are."""
    names = [f"x{i}" for i in range(len(xs))]
    parts = lambda k: F.struct(k.alias("k"), _text(k).alias("t"), _lang(k).alias("l"), _datatype(k).alias("d"))
    more = lambda v: F.struct(v["k"].alias("k"), v["t"].alias("t"), v["l"].alias("l"), v["d"].alias("d"), _rank(v["d"], v["t"]).alias("r"), _double(v["t"]).alias("n"))
    return _let(
        F.struct(*[x.alias(n) for x, n in zip(xs, names, strict=True)]),
        lambda keys: _let(
            F.struct(*[parts(keys[n]).alias(n) for n in names]),
            lambda some: _let(F.struct(*[more(some[n]).alias(n) for n in names]), lambda all_: fn(*[Term(all_[n]) for n in names])),
        ),
    )


# kinds and parts of a term


def is_iri(x: Column) -> Column:
    return x.startswith("<") & ~x.startswith("<<")


def is_blank(x: Column) -> Column:
    return x.startswith("_:")


def is_literal(x: Column) -> Column:
    return x.startswith('"')


def is_triple(x: Column) -> Column:
    return x.startswith("<<")


def _unescape(text: Column) -> Column:
    for coded, raw in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def _text(x: Column) -> Column:
    inside = F.regexp_extract(x, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    return F.when(is_literal(x), F.when(x.contains("\\"), _unescape(inside)).otherwise(inside)).when(is_iri(x), F.regexp_extract(x, "^<(.*)>$", 1))


def _lang(x: Column) -> Column:
    return F.when(is_literal(x), F.regexp_extract(x, r'"@([A-Za-z0-9-]+)$', 1))


def _datatype(x: Column) -> Column:
    tail = F.regexp_extract(x, r'"(@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    kind = F.when(tail == "", t.XSD + "string").when(tail.startswith("@"), t.RDF + "langString").otherwise(F.regexp_extract(x, r'"\^\^<([^>]*)>$', 1))
    return F.when(is_literal(x), kind)


def _rank(dt: Column, lexical: Column) -> Column:
    return (
        F.when(dt.isin(*[t.XSD + n for n in INTEGERS]) & lexical.rlike(_INTEGER), 1)
        .when((dt == t.XSD + "decimal") & lexical.rlike(_DECIMAL), 2)
        .when((dt == t.XSD + "float") & lexical.rlike(_DOUBLE), 3)
        .when((dt == t.XSD + "double") & lexical.rlike(_DOUBLE), 4)
    )


def text(x: Column) -> Column:
    """STR: the lexical form of a literal, an IRI as text; null for other terms."""
    return _let(x, _text)


def lang(x: Column) -> Column:
    """LANG: the tag of a literal, empty if it has none; null for other terms."""
    return _let(x, _lang)


def datatype(x: Column) -> Column:
    """DATATYPE as plain text; null for terms that are no literals."""
    return _let(x, _datatype)


def numeric_rank(x: Column) -> Column:
    """Place of a literal's datatype in NUMERIC, from 1; null if it is not numeric or its text is not a number."""
    return _open(lambda a: a.rank, x)


def is_numeric(x: Column) -> Column:
    return numeric_rank(x).isNotNull()


def _double(lexical: Column) -> Column:
    trimmed = F.trim(lexical)
    return F.when(trimmed.rlike(_DOUBLE), F.regexp_replace(trimmed, "INF", "Infinity").try_cast("double"))


def number(x: Column) -> Column:
    """Value of a numeric literal as a double."""
    return _open(lambda a: F.when(a.rank.isNotNull(), a.number), x)


# building terms


def literal(lexical: Column, kind: str | Column | None = None, tag: str | Column | None = None) -> Column:
    return t.literal_key(lexical, t._column(kind), t._column(tag))


def typed(lexical: Column, name: str) -> Column:
    return literal(lexical, t.XSD + name)


def boolean(value: Column) -> Column:
    return typed(value.cast("string"), "boolean")


def integer(value: Column) -> Column:
    return typed(value.cast("decimal(38,0)").cast("string"), "integer")


def _plain(value: Column) -> Column:
    """Decimal text without zeros at its end."""
    digits = value.cast("string")
    return F.when(digits.contains("."), F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", "")).otherwise(digits)


def decimal(value: Column) -> Column:
    return typed(_plain(value.cast("decimal(38,18)")), "decimal")


def double(value: Column, name: str = "double") -> Column:
    special = lambda v: F.when(F.isnan(v), "NaN").when(v == float("inf"), "INF").when(v == float("-inf"), "-INF").otherwise(v.cast("string"))
    return typed(_let(value, special), name)


def iri(x: Column, base: str = t.BASE) -> Column:
    """IRI: text as an IRI, below ``base`` if it is not absolute."""

    def fn(a: Term) -> Column:
        whole = a.text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
        return F.when(is_iri(a.key), a.key).when(a.literal, t.iri_key(F.when(whole, a.text).otherwise(F.concat(F.lit(base), a.text))))

    return _open(fn, x)


def bnode(label: Column) -> Column:
    """BNODE: a blank node named by a label of the solution, the same for equal labels."""
    return F.concat(F.lit("_:b"), F.substring(F.sha2(label, 256), 1, 26))


def strdt(x: Column, kind: Column) -> Column:
    return _open(lambda a, k: F.when(a.literal & a.has("string") & is_iri(k.key), literal(a.text, k.text)), x, kind)


def strlang(x: Column, tag: Column) -> Column:
    return _open(lambda a, b: F.when(a.literal & a.has("string") & (b.text != ""), literal(a.text, None, b.text)), x, tag)


def langmatches(tag: Column, wanted: Column) -> Column:
    """Basic filtering of language tags, ``*`` for any."""

    def fn(a: Term, b: Term) -> Column:
        have, want = F.lower(a.text), F.lower(b.text)
        return F.when(want == "*", have != "").otherwise((have == want) | have.startswith(F.concat(want, F.lit("-"))))

    return _open(fn, tag, wanted)


def uuid() -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))


def struuid() -> Column:
    return literal(F.uuid())


# strings: results keep the language tag or datatype of the first argument


def _like(a: Term, result: Column) -> Column:
    return F.when(a.plain, literal(result, None, F.when(a.lang != "", a.lang)))


def _compatible(a: Term, b: Term) -> Column:
    return a.literal & b.literal & ((b.lang == "") | (a.lang == b.lang))


def strlen(x: Column) -> Column:
    return _open(lambda a: F.when(a.literal, F.length(a.text)), x)


def substr(x: Column, start: Column, length: Column | None = None) -> Column:
    """SUBSTR: places count from 1; what lies before the text is cut off."""
    first = F.floor(start + F.lit(0.5)).cast("int")
    begin = F.greatest(first, F.lit(1))
    if length is None:
        return _open(lambda a: _like(a, F.substring(a.text, begin, F.length(a.text))), x)
    end = first + F.floor(length + F.lit(0.5)).cast("int")
    return _open(lambda a: _like(a, F.substring(a.text, begin, F.greatest(end - begin, F.lit(0)))), x)


def ucase(x: Column) -> Column:
    return _open(lambda a: _like(a, F.upper(a.text)), x)


def lcase(x: Column) -> Column:
    return _open(lambda a: _like(a, F.lower(a.text)), x)


def strstarts(x: Column, y: Column) -> Column:
    return _open(lambda a, b: F.when(_compatible(a, b), a.text.startswith(b.text)), x, y)


def strends(x: Column, y: Column) -> Column:
    return _open(lambda a, b: F.when(_compatible(a, b), a.text.endswith(b.text)), x, y)


def contains(x: Column, y: Column) -> Column:
    return _open(lambda a, b: F.when(_compatible(a, b), a.text.contains(b.text)), x, y)


def _around(x: Column, y: Column, cut) -> Column:
    def fn(a: Term, b: Term) -> Column:
        at = F.instr(a.text, b.text)
        return F.when(_compatible(a, b), F.when(at > 0, _like(a, cut(a.text, at, F.length(b.text)))).otherwise(literal(F.lit(""))))

    return _open(fn, x, y)


def strbefore(x: Column, y: Column) -> Column:
    """What stands before the first ``y``, empty and without a tag if there is none."""
    return _around(x, y, lambda value, at, n: F.substring(value, F.lit(1), at - 1))


def strafter(x: Column, y: Column) -> Column:
    """What stands after the first ``y``, empty and without a tag if there is none."""
    return _around(x, y, lambda value, at, n: F.substring(value, at + n, F.length(value)))


def encode_for_uri(x: Column) -> Column:
    """Per-cent encoding of all but unreserved characters."""

    def fn(a: Term) -> Column:
        coded = F.url_encode(a.text)
        for wrong, right in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            coded = F.replace(coded, F.lit(wrong), F.lit(right))
        return F.when(a.literal, literal(coded))

    return _open(fn, x)


def concat(*xs: Column) -> Column:
    """CONCAT: one tag that all share stays."""

    def fn(*terms: Term) -> Column:
        shared = reduce(Column.__and__, [a.lang == terms[0].lang for a in terms], F.lit(True)) & (terms[0].lang != "")
        whole = F.concat(*[a.text for a in terms])
        return F.when(reduce(Column.__and__, [a.literal for a in terms]), literal(whole, None, F.when(shared, terms[0].lang)))

    return _open(fn, *xs)


def _flags(pattern: str, flags: str) -> str:
    """A pattern with XPath's flags i, s, m, x (and q: no special characters) as Java has them."""
    if "q" in flags:
        pattern = "".join("\\" + c if c in "\\.[]{}()*+-?^$|" else c for c in pattern)
    kept = "".join(sorted(set(flags) & set("ismx")))
    return f"(?{kept}){pattern}" if kept else pattern


def regex(x: Column, pattern: str, flags: str = "") -> Column:
    return _open(lambda a: F.when(a.literal, a.text.rlike(_flags(pattern, flags))), x)


def replace(x: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return _open(lambda a: _like(a, F.regexp_replace(a.text, _flags(pattern, flags), replacement)), x)


# numbers


def _exact(a: Term, kind: str = "decimal(38,10)") -> Column:
    return F.trim(a.text).try_cast(kind)


def _result(rank: Column, whole: Column, exact: Column, wide: Column) -> Column:
    """A number of the datatype at place ``rank``."""
    return F.when(rank == 1, integer(whole)).when(rank == 2, decimal(exact)).when(rank == 3, double(wide.cast("float"), "float")).when(rank == 4, double(wide))


def _arithmetic(x: Column, y: Column, op, least: int = 1) -> Column:
    """A result of the wider operand's datatype, of at least place ``least``."""

    def fn(a: Term, b: Term) -> Column:
        rank = F.when(a.rank.isNotNull() & b.rank.isNotNull(), F.greatest(a.rank, b.rank, F.lit(least)))
        whole = op(_exact(a, "decimal(38,0)"), _exact(b, "decimal(38,0)"))
        return _result(rank, whole, op(_exact(a), _exact(b)), op(a.number, b.number))

    return _open(fn, x, y)


def add(x: Column, y: Column) -> Column:
    return _arithmetic(x, y, F.try_add)


def subtract(x: Column, y: Column) -> Column:
    return _arithmetic(x, y, F.try_subtract)


def multiply(x: Column, y: Column) -> Column:
    return _arithmetic(x, y, F.try_multiply)


def divide(x: Column, y: Column) -> Column:
    """Integers divide to a decimal; division by zero is an error but for floating point."""

    def fn(a: Term, b: Term) -> Column:
        floating = (F.greatest(a.rank, b.rank) >= 3) & (b.number == 0) & a.rank.isNotNull() & b.rank.isNotNull()
        by_zero = F.when((a.number == 0) | F.isnan(a.number), float("nan")).when(a.number > 0, float("inf")).otherwise(float("-inf"))
        return F.when(floating, double(by_zero)).otherwise(_arithmetic(a.key, b.key, F.try_divide, 2))

    return _open(fn, x, y)


def negate(x: Column) -> Column:
    return subtract(typed(F.lit("0"), "integer"), x)


def _unary(x: Column, exact, wide) -> Column:
    return _open(lambda a: _result(a.rank, exact(_exact(a)), exact(_exact(a)), wide(a.number)), x)


def abs_(x: Column) -> Column:
    return _unary(x, F.abs, F.abs)


def round_(x: Column) -> Column:
    """Halves go up, towards positive infinity."""
    return _unary(x, lambda v: F.floor(v + F.lit("0.5").cast("decimal(2,1)")), lambda v: F.floor(v + 0.5).cast("double"))


def ceil(x: Column) -> Column:
    return _unary(x, F.ceil, lambda v: F.ceil(v).cast("double"))


def floor(x: Column) -> Column:
    return _unary(x, F.floor, lambda v: F.floor(v).cast("double"))


def rand(seed: int | None = None) -> Column:
    return double(F.rand(seed))


# dates and times: parts come from the text, so that a zone changes nothing


def now() -> Column:
    return typed(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "dateTime")


def _part(x: Column, place: int, make=None) -> Column:
    def fn(a: Term) -> Column:
        return F.when(a.has("dateTime") & a.text.rlike(_DATETIME), F.regexp_extract(a.text, _DATETIME, place))

    return _open(fn, x) if make is None else _let(_open(fn, x), make)


def year(x: Column) -> Column:
    return _part(x, 1, integer)


def month(x: Column) -> Column:
    return _part(x, 2, integer)


def day(x: Column) -> Column:
    return _part(x, 3, integer)


def hours(x: Column) -> Column:
    return _part(x, 4, integer)


def minutes(x: Column) -> Column:
    return _part(x, 5, integer)


def seconds(x: Column) -> Column:
    return _part(x, 6, decimal)


def tz(x: Column) -> Column:
    """TZ: the zone as it is written, empty if there is none."""
    return _part(x, 7, literal)


def timezone(x: Column) -> Column:
    """TIMEZONE as a duration; an error without a zone."""

    def fn(zone: Column) -> Column:
        hour, minute = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
        part = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.lit(name))).otherwise("")
        written = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), part(hour, "H"), part(minute, "M"))
        zero = (zone == "Z") | ((hour == 0) & (minute == 0))
        return F.when(zone != "", typed(F.when(zero, "PT0S").otherwise(written), "dayTimeDuration"))

    return _part(x, 7, fn)


def _instant(a: Term) -> Column:
    zoned = F.when(a.text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), a.text).otherwise(F.concat(a.text, F.when(a.has("dateTime"), "Z").otherwise("T00:00:00Z")))
    return F.when(a.has("dateTime", "date"), F.try_to_timestamp(zoned))


def instant(x: Column) -> Column:
    """A dateTime or date as a timestamp; without a zone it is taken as UTC."""
    return _open(_instant, x)


# hashes


def _hashed(x: Column, fn) -> Column:
    return _open(lambda a: F.when(a.plain, literal(fn(a.text))), x)


def md5(x: Column) -> Column:
    return _hashed(x, F.md5)


def sha1(x: Column) -> Column:
    return _hashed(x, F.sha1)


def sha256(x: Column) -> Column:
    return _hashed(x, lambda c: F.sha2(c, 256))


def sha384(x: Column) -> Column:
    return _hashed(x, lambda c: F.sha2(c, 384))


def sha512(x: Column) -> Column:
    return _hashed(x, lambda c: F.sha2(c, 512))


# comparison and truth


def _truth(a: Term) -> Column:
    return F.when(a.has("boolean"), a.text.isin("true", "1")).when(a.rank.isNotNull(), (a.number != 0) & ~F.isnan(a.number)).when(a.plain, a.text != "")


def truth(x: Column) -> Column:
    """Effective boolean value: of booleans, numbers and strings; null for any other term."""
    return _open(_truth, x)


def equal(x: Column, y: Column) -> Column:
    """Numbers, times and booleans by value, other terms by key."""

    def fn(a: Term, b: Term) -> Column:
        times = a.has("dateTime", "date") & b.has("dateTime", "date")
        return (
            F.when(a.rank.isNotNull() & b.rank.isNotNull(), a.number == b.number)
            .when(times, F.coalesce(_instant(a) == _instant(b), a.key == b.key)).when(a.has("boolean") & b.has("boolean"), _truth(a) == _truth(b)).otherwise(a.key == b.key)
        )

    return _open(fn, x, y)


def less(x: Column, y: Column) -> Column:
    """x < y of two numbers, times, booleans or strings; null for anything else."""

    def fn(a: Term, b: Term) -> Column:
        return (
            F.when(a.rank.isNotNull() & b.rank.isNotNull(), a.number < b.number)
            .when(a.has("dateTime", "date") & b.has("dateTime", "date"), _instant(a) < _instant(b))
            .when(a.has("boolean") & b.has("boolean"), _truth(a) < _truth(b)).when(a.has("string") & b.has("string"), a.text < b.text)
        )

    return _open(fn, x, y)


# casts


def cast(x: Column, name: str) -> Column:
    """A constructor function of XSD (integer, decimal, float, double, string, boolean, dateTime); null if the value has none."""
    if name not in _CASTS:
        raise ValueError(f"no cast to {name}")
    return _open(_CASTS[name], x)


def _to_boolean(a: Term) -> Column:
    given = F.trim(a.text)
    of_text = F.when(given.isin("true", "1"), True).when(given.isin("false", "0"), False)
    return boolean(F.when(a.has("boolean") | a.has("string"), of_text).when(a.rank.isNotNull(), _truth(a)))


def _digits(a: Term) -> Column:
    """Text of a number that is to become an exact one; 1 and 0 of booleans."""
    given = F.trim(a.text)
    wide = F.when((a.rank >= 3) & ~given.rlike(_DECIMAL), a.number.try_cast("decimal(38,18)").cast("string"))
    exact = F.when(given.rlike(_DECIMAL), given).otherwise(wide)
    return F.when(a.has("boolean"), F.when(given.isin("true", "1"), "1").otherwise("0")).when(a.rank.isNotNull() | a.has("string"), exact)


def _to_integer(a: Term) -> Column:
    return integer(F.when(~a.has("string") | F.trim(a.text).rlike(_INTEGER), F.regexp_replace(_digits(a).try_cast("decimal(38,18)").cast("string"), r"\..*$", "")))


def _to_wide(name: str):
    def fn(a: Term) -> Column:
        wide = F.when(a.has("boolean"), F.when(a.text.isin("true", "1"), 1.0).otherwise(0.0)).when(a.rank.isNotNull() | a.has("string"), a.number)
        return double(wide.cast("float") if name == "float" else wide, name)

    return fn


def _to_datetime(a: Term) -> Column:
    given = F.trim(a.text)
    midnight = F.concat(F.substring(given, 1, 10), F.lit("T00:00:00"), F.substring(given, 11, 6))
    sound = lambda v: F.when(v.rlike(_DATETIME) & F.try_to_timestamp(F.substring(v, 1, 19)).isNotNull(), v)
    return typed(_let(F.when(a.has("date"), midnight).when(a.has("dateTime", "string"), given), sound), "dateTime")


_CASTS = {
    "string": lambda a: F.when(a.literal | is_iri(a.key), literal(a.text)), "boolean": _to_boolean, "integer": _to_integer,
    "decimal": lambda a: decimal(_digits(a).try_cast("decimal(38,18)")), "float": _to_wide("float"), "double": _to_wide("double"), "dateTime": _to_datetime,
}


# quoted triples


def triple(s: Column, p: Column, o: Column) -> Column:
    """TRIPLE of three keys; null unless the subject is a node and the predicate an IRI."""
    sound = (is_iri(s) | is_blank(s)) & is_iri(p) & o.isNotNull()
    return F.when(sound, F.concat(F.lit("<<( "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" )>>")))


def _inside(x: Column) -> Column:
    return F.when(is_triple(x), F.regexp_extract(x, r"(?s)^<<\( (.*) \)>>$", 1))


def subject(x: Column) -> Column:
    return F.nullif(F.substring_index(_inside(x), " ", 1), F.lit(""))


def predicate(x: Column) -> Column:
    return F.nullif(F.regexp_extract(_inside(x), r"^\S+ (\S+) ", 1), F.lit(""))


def object_(x: Column) -> Column:
    return F.nullif(F.regexp_extract(_inside(x), r"(?s)^\S+ \S+ (.*)$", 1), F.lit(""))
