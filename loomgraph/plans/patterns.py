"""Queries over ingest, scans and pattern matching, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators import algebra as A
from ..operators import fixpoint
from ..sources import mapping
from .graph import MAPPINGS, kg, node, p, table
from .registry import registry

QUERIES, SQL, query = registry()
NODE = t.ID
TYPE = f"<{t.TYPE}>"
LABEL = f"<{t.LABEL}>"


def lex(name: str, cast: str | None = None):
    out = A.text(F.col(name))
    return (out.cast(cast) if cast else out).alias(name)


def key_of(name: str, kind: str = "long"):
    """The table key at the end of a node's IRI."""
    return F.regexp_extract(A.text(F.col(name)), r"([^/]+)$", 1).cast(kind)


# ingest and scans


@query("""
SELECT 'type' AS predicate, ((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part))::BIGINT AS n
UNION ALL SELECT 'externalKey', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part)
UNION ALL SELECT 'label', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part)
UNION ALL SELECT 'inRegion', count(*) FROM nation UNION ALL SELECT 'inNation', count(*) FROM customer
UNION ALL SELECT 'acctbal', count(*) FROM customer UNION ALL SELECT 'segment', count(*) FROM customer
UNION ALL SELECT 'brand', count(*) FROM part UNION ALL SELECT 'size', count(*) FROM part UNION ALL SELECT 'price', count(*) FROM part
UNION ALL SELECT 'part type', count(*) FROM part""")
def map_predicate_counts(spark, d):
    rows = kg(spark, d, "region", "nation", "customer", "part")
    name = F.when(F.col("p") == t.ONT + "type", "part type").otherwise(t.local_name(F.col("p")))
    return rows.groupBy(name.alias("predicate")).agg(F.count("*").alias("n"))


@query("""
WITH v AS (
  SELECT l_orderkey::VARCHAR AS x FROM lineitem UNION ALL SELECT l_quantity::VARCHAR FROM lineitem
  UNION ALL SELECT l_returnflag FROM lineitem UNION ALL SELECT strftime(l_shipdate, '%Y-%m-%d') FROM lineitem
  UNION ALL SELECT (l_quantity > 25)::VARCHAR FROM lineitem UNION ALL SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') FROM lineitem
)
SELECT CASE WHEN lower(x) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN 'integer'
  WHEN regexp_full_match(x, '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)') THEN 'decimal' WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date'
  WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}T.*') THEN 'dateTime' ELSE 'string' END AS datatype, count(*) AS n
FROM v GROUP BY 1""")
def infer_datatype_hist(spark, d):
    rows = table(spark, d, "lineitem")
    cells = F.explode(F.array(
        F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"), F.col("l_returnflag"), F.date_format("l_shipdate", "yyyy-MM-dd"),
        (F.col("l_quantity") > 25).cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"),
    ))
    return rows.select(cells.alias("x")).groupBy(t.local_name(t.infer_datatype(F.col("x"))).alias("datatype")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand AS label, 'ref:https://kg.example/ont#brand:' || p_brand AS key FROM part")
def reference_nodes(spark, d):
    rows = mapping.reference_nodes(table(spark, d, "part"), MAPPINGS["part"])
    label = F.max(F.when(F.col("p") == t.LABEL, F.col("o"))).alias("label")
    return rows.groupBy("s").agg(label, F.max(F.when(F.col("p") == t.EXTERNAL_KEY, F.col("o"))).alias("key")).drop("s")


@query("SELECT count(*) AS nodes, count(*) AS labels FROM customer")
def rekey_upsert(spark, d):
    """A second ingest finds the nodes that the first one made."""
    customers = table(spark, d, "customer")
    first = mapping.ingest(customers.filter("c_custkey % 2 = 0"), MAPPINGS["customer"])
    again = mapping.ingest(customers, MAPPINGS["customer"], mapping.known_keys(first))
    rows = t.as_set(first.unionByName(again))
    return rows.agg(F.countDistinct("s").alias("nodes"), F.count(F.when(F.col("p") == t.LABEL, 1)).alias("labels"))


@query("SELECT 'urn:kg:data' AS g, ((SELECT count(*) FROM region) * 3 + (SELECT count(*) FROM nation) * 4 + (SELECT count(*) FROM customer) * 6)::BIGINT AS n")
def graph_stats(spark, d):
    return A.counts(kg(spark, d, "region", "nation", "customer"))


@query("SELECT 'urn:kg:data' AS g")
def list_graphs(spark, d):
    return A.graphs(kg(spark, d, "region", "nation", "supplier"))


@query("SELECT count(*) * 4 AS n FROM nation")
def contains_semi(spark, d):
    return A.contained(kg(spark, d, "nation", "supplier"), kg(spark, d, "region", "nation")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def pattern_scan_p(spark, d):
    return A.scan(kg(spark, d, "customer"), p=t.ONT + "segment").groupBy(F.col("o").alias("segment")).agg(F.count("*").alias("n"))


@query(f"SELECT '{NODE}customer/' || c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING'")
def pattern_scan_po(spark, d):
    return A.scan(kg(spark, d, "customer"), p=t.ONT + "segment", o_key='"BUILDING"').select("s")


@query(f"""SELECT 'label' AS p, n_name AS o FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'externalKey', '7'
UNION ALL SELECT 'type', 'https://kg.example/ont#Nation' UNION ALL SELECT 'inRegion', '{NODE}region/' || n_regionkey FROM nation WHERE n_nationkey = 7""")
def pattern_scan_s(spark, d):
    return A.scan(kg(spark, d, "region", "nation"), s=node("nation", 7)).select(t.local_name(F.col("p")).alias("p"), "o")


# patterns


@query("SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def bgp_2hop(spark, d):
    rows = kg(spark, d, "orders", "customer", "nation")
    found = A.bgp(rows, [("?o", p("placedBy"), "?c"), ("?c", p("inNation"), "?x"), ("?x", LABEL, "?nation")])
    return found.groupBy("nation").agg(F.count("*").alias("n")).select(lex("nation"), "n")


@query("SELECT p_partkey AS part, p_name AS name, p_type AS kind, p_retailprice AS price FROM part WHERE p_size = 15")
def bgp_star(spark, d):
    size = f'"15"^^<{t.XSD}integer>'
    found = A.bgp(kg(spark, d, "part"), [("?part", p("size"), size), ("?part", LABEL, "?name"), ("?part", p("type"), "?kind"), ("?part", p("price"), "?price")])
    return found.select(key_of("part").alias("part"), lex("name"), lex("kind"), A.number(F.col("price")).alias("price"))


@query("SELECT n_nationkey AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) * (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS pairs FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def bgp_cycle(spark, d):
    rows = kg(spark, d, "customer", "supplier")
    sides = [A.bgp(rows, [("?x", TYPE, p(c)), ("?x", p("inNation"), "?n")]).groupBy("n").agg(F.count("*").alias(c)) for c in ("Customer", "Supplier")]
    return A.join(*sides).select(key_of("n", "int").alias("nation"), (F.col("Customer") * F.col("Supplier")).alias("pairs"))


def _urgent(rows: DataFrame) -> DataFrame:
    return A.bgp(rows, [("?o", p("priority"), '"1-URGENT"'), ("?o", p("placedBy"), "?c")])


@query("SELECT c_custkey AS customer, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1")
def optional_left(spark, d):
    rows = kg(spark, d, "customer", "orders")
    found = A.optional(A.match(rows, ("?c", TYPE, p("Customer"))), _urgent(rows))
    return found.groupBy("c").agg(F.count("o").alias("n")).select(key_of("c").alias("customer"), "n")


@query("SELECT n_nationkey AS nation, ((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey))::BIGINT AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def union_bag(spark, d):
    parts = [A.match(kg(spark, d, x), ("?x", p("inNation"), "?n")) for x in ("customer", "supplier")]
    return A.union(*parts).groupBy("n").agg(F.count("*").alias("n_")).select(key_of("n", "int").alias("nation"), F.col("n_").alias("n"))


@query("SELECT c_custkey AS customer FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def minus_shared(spark, d):
    rows = kg(spark, d, "customer", "orders")
    return A.minus(A.match(rows, ("?c", TYPE, p("Customer"))), _urgent(rows)).select(key_of("c").alias("customer"))


@query("SELECT count(*) AS n FROM nation")
def minus_disjoint(spark, d):
    rows = kg(spark, d, "region", "nation")
    return A.minus(A.match(rows, ("?n", TYPE, p("Nation"))), A.match(rows, ("?r", TYPE, p("Region")))).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS o, o_totalprice AS total FROM orders WHERE o_totalprice > 300000")
def filter_numeric(spark, d):
    total = A.number(F.col("t"))
    return A.match(kg(spark, d, "orders"), ("?o", p("total"), "?t")).filter(total > 300000).select(key_of("o").alias("o"), total.alias("total"))


@query("SELECT p_partkey AS part, p_name AS name FROM part WHERE regexp_matches(p_name, '^[a-m].*e')")
def filter_regex(spark, d):
    return A.match(kg(spark, d, "part"), ("?part", LABEL, "?name")).filter(A.text(F.col("name")).rlike("^[a-m].*e")).select(key_of("part").alias("part"), lex("name"))


@query("SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2")
def filter_lang(spark, d):
    docs = table(spark, d, "documents")
    rows = t.quads(docs, mapping.node_iri("documents", F.col("doc_id")), [t.literal_object(t.ONT + "source", F.col("source"), lang=F.col("lang"))])
    found = A.match(rows, ("?d", p("source"), "?x"))
    return found.groupBy(A.language(F.col("x")).alias("lang"), A.text(F.col("x")).alias("source")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def exists_semi(spark, d):
    rows = A.match(kg(spark, d, "orders"), ("?o", p("status"), "?s"))
    found = A.exists(rows, A.match(kg(spark, d, "lineitem"), ("?l", p("ofOrder"), "?o")))
    return found.groupBy(A.text(F.col("s")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def not_exists(spark, d):
    rows = A.match(kg(spark, d, "orders"), ("?o", TYPE, p("Order")))
    return A.exists(rows, A.match(kg(spark, d, "lineitem"), ("?l", p("ofOrder"), "?o")), negate=True).select(key_of("o").alias("o"))


@query("SELECT c_custkey AS customer, lower(c_mktsegment) AS low FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def bind_values(spark, d):
    given = A.values(spark, ["s"], [('"BUILDING"',), ('"MACHINERY"',)])
    found = A.join(A.match(kg(spark, d, "customer"), ("?c", p("segment"), "?s")), given)
    return found.select(key_of("c").alias("customer"), F.lower(A.text(F.col("s"))).alias("low"))


@query("SELECT o_orderkey AS o, c_name AS name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey::VARCHAR LIMIT 10) JOIN customer ON o_custkey = c_custkey")
def subselect_topk(spark, d):
    rows = kg(spark, d, "orders", "customer")
    top = A.match(rows, ("?o", p("total"), "?t")).orderBy(F.desc(A.number(F.col("t"))), "o").limit(10).select("o")
    return A.join(A.join(top, A.match(rows, ("?o", p("placedBy"), "?c"))), A.match(rows, ("?c", LABEL, "?name"))).select(key_of("o").alias("o"), lex("name"))


@query("SELECT c_custkey AS customer, c_acctbal AS acctbal FROM customer ORDER BY c_acctbal, c_custkey::VARCHAR LIMIT 10 OFFSET 5")
def order_slice(spark, d):
    found = A.match(kg(spark, d, "customer"), ("?c", p("acctbal"), "?b")).orderBy(*A.order_key(F.col("b")), "c").offset(5).limit(10)
    return found.select(key_of("c").alias("customer"), A.number(F.col("b")).alias("acctbal"))


@query("SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def distinct_proj(spark, d):
    found = A.bgp(kg(spark, d, "orders"), [("?o", p("status"), "?status"), ("?o", p("priority"), "?priority")])
    return found.select("status", "priority").distinct().select(lex("status"), lex("priority"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY 1")
def agg_group(spark, d):
    found = A.bgp(kg(spark, d, "customer"), [("?c", p("segment"), "?segment"), ("?c", p("acctbal"), "?b")]).withColumn("v", A.number(F.col("b")))
    return found.groupBy("segment").agg(
        F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.round(F.avg("v"), 4).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most")
    ).withColumn("segment", A.text(F.col("segment")))


@query("SELECT o_orderpriority AS priority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg_distinct(spark, d):
    found = A.bgp(kg(spark, d, "orders"), [("?o", p("priority"), "?priority"), ("?o", p("placedBy"), "?c")])
    return found.groupBy("priority").agg(F.countDistinct("c").alias("customers")).select(lex("priority"), "customers")


@query("SELECT r_name AS region, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def group_concat(spark, d):
    rows = kg(spark, d, "nation", "region")
    found = A.bgp(rows, [("?n", p("inRegion"), "?r"), ("?n", LABEL, "?x"), ("?r", LABEL, "?region")]).select(lex("region"), lex("x"))
    return found.groupBy("region").agg(F.array_join(F.sort_array(F.collect_list("x")), ", ").alias("nations"))


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1 HAVING avg(c_acctbal) > 4400")
def having(spark, d):
    found = A.bgp(kg(spark, d, "customer"), [("?c", p("inNation"), "?n"), ("?c", p("acctbal"), "?b")])
    sums = found.groupBy("n").agg(F.count("*").alias("k"), F.avg(A.number(F.col("b"))).alias("mean")).filter("mean > 4400")
    return sums.select(key_of("n", "int").alias("nation"), F.col("k").alias("n"))


@query("SELECT 0::BIGINT AS n")
def agg_empty(spark, d):
    return A.match(kg(spark, d, "nation"), ("?x", p("nothing"), "?y")).agg(F.count("*").alias("n"))


@query("SELECT r_name AS region, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def path_seq_alt(spark, d):
    rows = kg(spark, d, "customer", "supplier", "nation", "region")
    found = A.bgp(rows, [("?x", p("inNation"), "?n"), ("?n", p("inRegion"), "?r"), ("?r", LABEL, "?region")])
    return found.groupBy("region").agg(F.count("*").alias("n")).select(lex("region"), "n")


@query("SELECT conv_id, (count(*) * (count(*) - 1) / 2)::BIGINT AS pairs FROM conversations GROUP BY 1 HAVING count(*) > 1")
def path_plus(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turn = F.concat_ws("/", "conv_id", "turn")
    edges = table(spark, d, "conversations").select("conv_id", turn.alias("a"), F.lead(turn).over(w).alias("b"))
    made = fixpoint.closure(edges)
    return made.groupBy(F.substring_index("a", "/", 1).cast("long").alias("conv_id")).agg(F.count("*").alias("pairs"))


@query("SELECT true AS found")
def ask(spark, d):
    return A.match(kg(spark, d, "nation"), ("?n", p("inRegion"), "?r")).agg((F.count("*") > 0).alias("found"))


@query(f"SELECT '<{NODE}customer/' || c_custkey || '>' AS s, '{p('livesIn')}' AS p, '<{NODE}region/' || n_regionkey || '>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def construct_view(spark, d):
    found = A.bgp(kg(spark, d, "customer", "nation"), [("?c", p("inNation"), "?n"), ("?n", p("inRegion"), "?r")])
    return A.construct(found, [("?c", p("livesIn"), "?r")])


@query("SELECT p_partkey AS part, upper(p_name) AS up, length(p_name)::INTEGER AS n, substr(p_name, 2, 3) AS part_of, contains(p_name, 'a') AS has, starts_with(p_name, 's') AS starts, replace(p_name, ' ', '_') AS joined FROM part")
def functions_string(spark, d):
    x = A.text(F.col("name"))
    return A.match(kg(spark, d, "part"), ("?part", LABEL, "?name")).select(
        key_of("part").alias("part"), F.upper(x).alias("up"), F.length(x).alias("n"), F.substring(x, 2, 3).alias("part_of"), x.contains("a").alias("has"),
        x.startswith("s").alias("starts"), F.replace(x, F.lit(" "), F.lit("_")).alias("joined"),
    )


@query("SELECT p_partkey AS part, md5(p_name) AS m, sha256(p_name) AS s FROM part")
def functions_hash(spark, d):
    x = A.text(F.col("name"))
    return A.match(kg(spark, d, "part"), ("?part", LABEL, "?name")).select(key_of("part").alias("part"), F.md5(x).alias("m"), F.sha2(x, 256).alias("s"))


@query("SELECT o_orderkey AS o, abs(o_totalprice - 150000) AS away, ceil(o_totalprice)::BIGINT AS up, floor(o_totalprice)::BIGINT AS down FROM orders")
def functions_math(spark, d):
    x = A.number(F.col("t"))
    return A.match(kg(spark, d, "orders"), ("?o", p("total"), "?t")).select(key_of("o").alias("o"), F.abs(x - 150000).alias("away"), F.ceil(x).alias("up"), F.floor(x).alias("down"))


@query("SELECT 'uri' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'literal', count(*) * 2 FROM nation UNION ALL SELECT 'uri of type', count(*) FROM nation")
def result_encoding(spark, d):
    found = A.match(kg(spark, d, "nation"), ("?s", "?p", "?o")).select("p", F.get_json_object(A.encode(F.col("o")), "$.type").alias("kind"))
    kind = F.when(F.col("p") == TYPE, F.concat("kind", F.lit(" of type"))).otherwise(F.col("kind"))
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
