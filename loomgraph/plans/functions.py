"""Queries over scalar functions, property paths, unbound variables and aggregates, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import terms as t
from ..operators import algebra as A
from ..operators import graph_edit as E
from ..operators import paths as P
from .graph import kg, node, p, table
from .patterns import LABEL, NODE, TYPE, key_of
from .registry import registry

QUERIES, SQL, query = registry()


def _k(text: str):
    """A key given as text."""
    return F.lit(text)


# scalar functions


@query("""SELECT o_orderkey AS o, year(o_orderdate)::VARCHAR AS y, month(o_orderdate)::VARCHAR AS m, day(o_orderdate)::VARCHAR AS d,
'0' AS h, '0' AS mi, '0' AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '+09:00' END AS tz,
CASE WHEN o_orderkey % 2 = 0 THEN 'PT0S' ELSE 'PT9H' END AS zone,
(o_orderdate::DATE < (CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1995-01-01 00:00:00' ELSE TIMESTAMP '1995-01-01 09:00:00' END)) AS before FROM orders""")
def functions_date(spark, d):
    rows = table(spark, d, "orders")
    zone = F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise("+09:00")
    x = S.typed(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00"), zone), "dateTime")
    mark = _k(f'"1995-01-01T00:00:00Z"^^<{t.XSD}dateTime>')
    return rows.select(
        F.col("o_orderkey").alias("o"), S.text(S.year(x)).alias("y"), S.text(S.month(x)).alias("m"), S.text(S.day(x)).alias("d"), S.text(S.hours(x)).alias("h"),
        S.text(S.minutes(x)).alias("mi"), S.text(S.seconds(x)).alias("s"), S.text(S.tz(x)).alias("tz"), S.text(S.timezone(x)).alias("zone"), S.less(x, mark).alias("before"),
    )


@query("""SELECT o_orderkey AS o, trunc(o_totalprice)::BIGINT::VARCHAR AS whole, o_totalprice AS exact, o_totalprice AS wide, (o_orderkey % 2 = 0)::VARCHAR AS truth,
o_orderkey::VARCHAR AS text, NULL::VARCHAR AS none, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS moment FROM orders""")
def cast_matrix(spark, d):
    rows = table(spark, d, "orders")
    price, key = S.typed(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), "decimal"), S.typed(F.col("o_orderkey").cast("string"), "integer")
    day = S.typed(F.date_format("o_orderdate", "yyyy-MM-dd"), "date")
    parity = S.typed((F.col("o_orderkey") % 2 == 0).cast("int").cast("string"), "boolean")
    return rows.select(
        F.col("o_orderkey").alias("o"), S.text(S.cast(price, "integer")).alias("whole"), S.number(S.cast(price, "decimal")).alias("exact"),
        S.number(S.cast(S.cast(price, "string"), "double")).alias("wide"), S.text(S.cast(parity, "boolean")).alias("truth"), S.text(S.cast(key, "string")).alias("text"),
        S.cast(S.literal(F.lit("no number")), "integer").alias("none"), S.text(S.cast(day, "dateTime")).alias("moment"),
    )


@query("""SELECT n_nationkey AS nation, kind, iri, lit, num FROM nation, (VALUES ('type', true, false, false), ('label', false, true, false), ('externalKey', false, true, false), ('inRegion', true, false, false), ('key', false, true, true)) AS v(kind, iri, lit, num)""")
def functions_kinds(spark, d):
    rows = A.match(kg(spark, d, "nation"), ("?n", "?p", "?o"))
    numbers = rows.filter(F.col("p") == f"<{t.EXTERNAL_KEY}>").select("n", F.lit("<x#key>").alias("p"), S.cast(F.col("o"), "integer").alias("o"))
    both = rows.unionByName(numbers)
    return both.select(key_of("n", "int").alias("nation"), t.local_name(S.text(F.col("p"))).alias("kind"), S.is_iri(F.col("o")).alias("iri"), S.is_literal(F.col("o")).alias("lit"), S.is_numeric(F.col("o")).alias("num"))


@query(r"""SELECT p_partkey AS part, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END AS before,
CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS after, ends_with(p_name, 'e') AS ends, lower(p_name) AS low,
replace(p_name, ' ', '%20') AS coded, regexp_replace(p_name, '[aeiou]', '*', 'g') AS replaced, regexp_matches(p_name, '(?i)^[A-M]') AS early,
concat(p_brand, ': ', p_name) AS joined, substr(p_name, 3, 4) AS middle FROM part""")
def functions_more_strings(spark, d):
    rows = A.bgp(kg(spark, d, "part"), [("?part", LABEL, "?name")]).join(table(spark, d, "part").select(F.concat(F.lit(f"<{NODE}part/"), "p_partkey", F.lit(">")).alias("part"), S.literal(F.col("p_brand")).alias("brand")), "part")
    x, blank = F.col("name"), _k('" "')
    return rows.select(
        key_of("part").alias("part"), S.text(S.strbefore(x, blank)).alias("before"), S.text(S.strafter(x, blank)).alias("after"), S.strends(x, _k('"e"')).alias("ends"),
        S.text(S.lcase(x)).alias("low"), S.text(S.encode_for_uri(x)).alias("coded"), S.text(S.replace(x, "[AEIOU]", "*", "i")).alias("replaced"), S.regex(x, "^[A-M]", "i").alias("early"),
        S.text(S.concat(F.col("brand"), _k('": "'), x)).alias("joined"), S.text(S.substr(x, F.lit(3), F.lit(4))).alias("middle"),
    )


@query("""SELECT o_orderkey AS o, o_totalprice + o_orderkey AS added, 'decimal' AS kind, (o_orderkey / 4.0)::DOUBLE AS quarter, floor(o_totalprice + 0.5) AS rounded, -o_totalprice AS negative, o_orderkey * 3 AS three FROM orders""")
def functions_arithmetic(spark, d):
    rows = table(spark, d, "orders")
    price, key = S.typed(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), "decimal"), S.typed(F.col("o_orderkey").cast("string"), "integer")
    whole = lambda n: _k(f'"{n}"^^<{t.XSD}integer>')
    return rows.select(
        F.col("o_orderkey").alias("o"), S.number(S.add(price, key)).alias("added"), t.local_name(S.datatype(S.add(price, key))).alias("kind"), S.number(S.divide(key, whole(4))).alias("quarter"),
        S.number(S.round_(price)).alias("rounded"), S.number(S.negate(price)).alias("negative"), S.text(S.multiply(key, whole(3))).cast("long").alias("three"),
    )


@query("SELECT p_partkey AS part, sha1(p_name) AS a, md5(p_name) AS b FROM part")
def functions_more_hashes(spark, d):
    found = A.match(kg(spark, d, "part"), ("?part", LABEL, "?name"))
    return found.select(key_of("part").alias("part"), S.text(S.sha1(F.col("name"))).alias("a"), S.text(S.md5(F.col("name"))).alias("b"))


# paths


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1")
def path_inverse(spark, d):
    found = P.match(kg(spark, d, "customer"), "?n", P.inverse(P.link(t.ONT + "inNation")), "?c")
    return found.groupBy("n").agg(F.count("*").alias("k")).select(key_of("n", "int").alias("nation"), F.col("k").alias("n"))


@query("SELECT n_nationkey AS nation, 2::BIGINT AS n FROM nation")
def path_star_zero(spark, d):
    rows = kg(spark, d, "nation", "region")
    found = A.join(P.match(rows, "?n", P.star(P.link(t.ONT + "inRegion")), "?x"), A.match(rows, ("?n", TYPE, p("Nation"))))
    return found.groupBy("n").agg(F.count("*").alias("k")).select(key_of("n", "int").alias("nation"), F.col("k").alias("n"))


@query("SELECT s_nationkey AS nation, (count(*) * 2)::BIGINT AS n FROM supplier GROUP BY 1")
def path_opt(spark, d):
    """Suppliers and, where there is a step, their nations: each supplier is its own path of length zero."""
    rows = kg(spark, d, "supplier")
    found = P.match(rows, "?x", P.maybe(P.link(t.ONT + "inNation")), "?y")
    placed = A.join(found, A.match(rows, ("?x", p("inNation"), "?n")))
    return placed.groupBy("n").agg(F.count("*").alias("k")).select(key_of("n", "int").alias("nation"), F.col("k").alias("n"))


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def path_neg(spark, d):
    found = P.match(kg(spark, d, "nation"), "?n", P.negated(t.TYPE, t.LABEL, t.EXTERNAL_KEY), "?r")
    return found.groupBy("r").agg(F.count("*").alias("k")).select(key_of("r", "int").alias("region"), F.col("k").alias("n"))


@query("SELECT r_name AS region, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def path_alternatives(spark, d):
    """Two predicates for one step: suppliers are placed by another one."""
    rows = kg(spark, d, "customer", "supplier", "nation", "region")
    other = (F.col("p") == t.ONT + "inNation") & F.col("s").contains("/supplier/")
    rows = rows.withColumn("p", F.when(other, t.ONT + "seatIn").otherwise(F.col("p")))
    path = P.seq(P.alt(P.link(t.ONT + "inNation"), P.link(t.ONT + "seatIn")), P.link(t.ONT + "inRegion"), P.link(t.LABEL))
    return P.match(rows, "?x", path, "?region").groupBy(A.text(F.col("region")).alias("region")).agg(F.count("*").alias("n"))


@query("SELECT 'nation' AS kind, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def path_to_given_end(spark, d):
    """What leads to one region, followed back from there."""
    path = P.plus(P.alt(P.link(t.ONT + "inNation"), P.link(t.ONT + "inRegion")))
    found = P.match(kg(spark, d, "customer", "nation", "region"), "?x", path, f"<{node('region', 1)}>")
    return found.groupBy(F.regexp_extract("x", r"/(\w+)/[^/]+$", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT a.n_nationkey AS nation, count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey % 5 = b.n_nationkey % 5 GROUP BY 1")
def path_rings(spark, d):
    """Five rings of nations: the closure over strongly connected components."""
    rows = table(spark, d, "nation")
    n = rows.count()
    other = F.concat(F.lit(f"{t.ID}nation/"), ((F.col("n_nationkey") + 5) % n).cast("string"))
    quads = t.quads(rows, F.concat(F.lit(f"{t.ID}nation/"), F.col("n_nationkey").cast("string")), [t.iri_object(t.ONT + "next", other, t.DATA)])
    found = P.match(quads, "?a", P.plus(P.link(t.ONT + "next")), "?b")
    return found.groupBy("a").agg(F.count("*").alias("n")).select(key_of("a", "int").alias("nation"), "n")


# unbound variables, datasets, aggregates, updates


@query("SELECT c_custkey AS customer FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 3")
def minus_unbound(spark, d):
    """One solution to take away binds the segment only, the other the nation only."""
    found = A.bgp(kg(spark, d, "customer"), [("?c", p("segment"), "?s"), ("?c", p("inNation"), "?n")])
    gone = A.values(spark, ["s", "n"], [('"BUILDING"', None), (None, f"<{node('nation', 3)}>"), (None, None)])
    return A.minus(found, gone, unbound=("s", "n")).select(key_of("c").alias("customer"))


@query("SELECT c_custkey AS customer, c_mktsegment AS s, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS had FROM customer")
def optional_unbound(spark, d):
    """A variable that the first part leaves unbound is bound by the optional part."""
    rows = kg(spark, d, "customer")
    left = A.match(rows, ("?c", p("segment"), "?s")).withColumn("had", F.when(key_of("c") % 2 == 0, F.col("s")))
    left = left.select("c", F.col("had").alias("s"), "had")
    found = A.optional(left, A.match(rows, ("?c", p("segment"), "?s")), unbound=("s",))
    return found.select(key_of("c").alias("customer"), A.text(F.col("s")).alias("s"), A.text(F.col("had")).alias("had"))


@query("SELECT 'default' AS part, (SELECT count(*) FROM nation) * 4 + (SELECT count(*) FROM region) * 3 AS n UNION ALL SELECT 'urn:kg:copy', (SELECT count(*) FROM region) * 3")
def dataset_from(spark, d):
    rows = kg(spark, d, "nation", "region")
    copied = E.copy_graph(rows.filter(F.col("s").contains("/region/")), t.DATA, "urn:kg:copy")
    rows = A.dataset(rows.unionByName(copied.filter(F.col("g") == "urn:kg:copy")), [t.DATA, "urn:kg:copy"], ["urn:kg:copy"])
    return rows.groupBy(F.coalesce("g", F.lit("default")).alias("part")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS status, sum(o_orderkey)::VARCHAR AS total, 'integer' AS kind, round(avg(o_totalprice), 4) AS mean, NULL::VARCHAR AS wrong,
min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderpriority) AS one FROM orders GROUP BY 1""")
def agg_terms(spark, d):
    """SUM, AVG, MIN, MAX and SAMPLE of terms, with promotion and the error rule."""
    rows = kg(spark, d, "orders")
    found = A.bgp(rows, [("?o", p("status"), "?status"), ("?o", p("total"), "?t"), ("?o", f"<{t.EXTERNAL_KEY}>", "?k"), ("?o", p("priority"), "?pr")])
    found = found.withColumn("k", S.cast(F.col("k"), "integer"))
    out = found.groupBy("status").agg(A.sum_(F.col("k")).alias("s"), A.avg(F.col("t")).alias("m"), A.sum_(F.col("pr")).alias("wrong"), A.least(F.col("t")).alias("low"), A.most(F.col("t")).alias("high"), A.sample(F.col("pr")).alias("one"))
    return out.select(
        S.text(F.col("status")).alias("status"), S.text(F.col("s")).alias("total"), t.local_name(S.datatype(F.col("s"))).alias("kind"), F.round(S.number(F.col("m")), 4).alias("mean"),
        "wrong", S.number(F.col("low")).alias("low"), S.number(F.col("high")).alias("high"), S.text(F.col("one")).alias("one"),
    )


@query(f"SELECT 'https://kg.example/ont#' || CASE WHEN n_regionkey = 1 THEN 'partOf' ELSE 'inRegion' END AS p, '{NODE}region/' || n_regionkey AS o, count(*) AS n FROM nation GROUP BY 1, 2")
def update_templates(spark, d):
    """DELETE {?n inRegion ?r} INSERT {?n partOf ?r} WHERE for one region."""
    rows = kg(spark, d, "nation")
    found = A.match(rows, ("?n", p("inRegion"), "?r")).filter(F.col("r") == f"<{node('region', 1)}>")
    out = E.update(rows, found, [("?n", p("inRegion"), "?r")], [("?n", p("partOf"), "?r")])
    return out.filter(F.col("o").contains("/region/")).groupBy("p", "o").agg(F.count("*").alias("n"))
