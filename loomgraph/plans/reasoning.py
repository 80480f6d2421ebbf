"""Queries over inference, ontology, edits, validation and traversal, with the SQL they equal."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators import algebra as A
from ..operators import fixpoint
from ..operators import graph_edit as E
from ..operators import inference as I
from ..operators import same_as as M
from ..operators import shapes as S
from ..sources.quad_store import QuadStore
from ..storage import shared_dir
from .graph import kg, node, ontology, p, table
from .patterns import LABEL, NODE, TYPE, key_of, lex
from .registry import registry

QUERIES, SQL, query = registry()


# inference

#: What a rule's own facts match besides the intended premises.
_FURTHER = {"same-subject": [("?y", t.OWL + "sameAs", "?y")]}


def _whole(done: I.Inference) -> I.Inference:
    """An inference that no limit has cut short."""
    if done.hit_cap or not done.reached_fixed_point:
        raise RuntimeError(f"inference stopped at a limit after {done.rounds} rounds")
    return done


def _rule(rule: I.Rule):
    def run(spark, d):
        """The rule alone over one instance of its premises for each customer."""
        rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"))
        term = lambda x: F.concat(F.lit(f"<urn:v:{x[1:]}:"), "k", F.lit(">")) if x.startswith("?") else F.lit(f"<{x}>")
        made = F.explode(F.array(*[F.struct(*[term(x).alias(c) for c, x in zip("spo", triple, strict=True)]) for triple in rule.premises]))
        return _whole(I.materialise(rows.select(made.alias("f")).select("f.*"), (rule,))).derivations.select("s", "p", "o")

    term = lambda x: f"'<urn:v:{x[1:]}:' || c_custkey || '>'" if x.startswith("?") else f"'<{x}>'"
    made = [rule.conclusion, *_FURTHER.get(rule.name, [])]
    sql = " UNION ".join("SELECT " + ", ".join(f"{term(x)} AS {c}" for c, x in zip("spo", triple, strict=True)) + " FROM customer" for triple in made)
    return run, sql


for _r in I.RULES:
    _name = "rule_" + re.sub(r"\W", "_", _r.name)
    QUERIES[_name], SQL[_name] = _rule(_r)


def _inferred(spark, d, profile: str):
    facts = I.facts_of(kg(spark, d, "region", "nation", "customer", "supplier").unionByName(ontology(spark)))
    return facts, _whole(I.materialise(facts, profile))


@query("SELECT r_name AS region, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def parties_per_region(spark, d):
    """Parties are found by subclass, regions by a transitive super-property."""
    facts, done = _inferred(spark, d, "rl-lite")
    whole = facts.union(done.derivations.select("s", "p", "o"))
    of = lambda pred: whole.filter(F.col("p") == pred)
    party = of(TYPE).filter(F.col("o") == p("Party")).select(F.col("s").alias("c"))
    region = of(TYPE).filter(F.col("o") == p("Region")).select(F.col("s").alias("r"))
    located = of(p("locatedIn")).select(F.col("s").alias("c"), F.col("o").alias("r"))
    named = of(LABEL).select(F.col("s").alias("r"), F.col("o").alias("region"))
    found = A.join(A.join(A.join(located, party), region), named)
    return found.groupBy("region").agg(F.count("*").alias("n")).select(lex("region"), "n")


_PARTIES = "((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier))"


@query(f"""SELECT 'subclass-instance' AS rule, 1 AS round, {_PARTIES}::BIGINT AS n UNION ALL SELECT 'subproperty-value', 1, {_PARTIES} + (SELECT count(*) FROM nation)
UNION ALL SELECT 'transitive', 2, {_PARTIES} UNION ALL SELECT 'subclass-transitive', 1, 2 UNION ALL SELECT 'subclass-instance', 2, {_PARTIES}""")
def provenance_counts(spark, d):
    """First derivations by rule and round."""
    return _inferred(spark, d, "rl-lite")[1].derivations.groupBy("rule", "round").agg(F.count("*").alias("n"))


@query(f"SELECT 'subclass-instance' AS rule, (2 * {_PARTIES})::BIGINT AS n UNION ALL SELECT 'subproperty-value', {_PARTIES} + (SELECT count(*) FROM nation) UNION ALL SELECT 'subclass-transitive', 2")
def closure_rdfs(spark, d):
    return _inferred(spark, d, "rdfs")[1].derivations.groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT 10::BIGINT AS n, true AS capped")
def derivation_cap(spark, d):
    facts = I.facts_of(kg(spark, d, "customer").unionByName(ontology(spark)))
    done = I.materialise(facts, "rdfs", max_derived=10)
    return done.derivations.agg(F.count("*").alias("n"), F.lit(done.hit_cap).alias("capped"))


@query(f"SELECT 'subclass-instance' AS rule, '<{NODE}customer/1> {TYPE} {p('Customer')}' AS f0, '{p('Customer')} <{t.RDFS}subClassOf> {p('Party')}' AS f1")
def explain_triple(spark, d):
    done = _inferred(spark, d, "rdfs")[1]
    return I.explain(done.derivations, f"<{node('customer', 1)}>", TYPE, p("Party")).select("rule", "f0", "f1")


# ontology


_INSTANCES = "CASE cls WHEN 'Customer' THEN (SELECT count(*) FROM customer) WHEN 'Supplier' THEN (SELECT count(*) FROM supplier) WHEN 'Nation' THEN (SELECT count(*) FROM nation) WHEN 'Region' THEN (SELECT count(*) FROM region) ELSE 0 END AS n"


def _with_instances(found, spark, d):
    """Classes (iri) with the number of their own instances in the tables."""
    counts = E.instance_counts(kg(spark, d, "customer", "supplier", "nation", "region")).withColumnRenamed("cls", "iri")
    return found.join(counts, "iri", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"SELECT cls, parents, {_INSTANCES} FROM (VALUES ('Customer', 'Party'), ('Supplier', 'Party'), ('Party', 'Thing'), ('Region', ''), ('Nation', '')) v(cls, parents)")
def class_tree(spark, d):
    found = _with_instances(E.class_parents(ontology(spark)).filter(~F.col("iri").endswith("#locatedIn")), spark, d)
    return found.select(t.local_name(F.col("iri")).alias("cls"), F.array_join(F.transform("parents", t.local_name), ",").alias("parents"), "n")


def _brands(spark, d):
    """A class for each brand below that of its maker, the first digit, and these below one; parts are instances of their brand."""
    rows = table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)$", 1).alias("b"))
    names = rows.select("b").distinct()
    maker = F.concat(F.lit(t.ONT + "Maker"), F.substring("b", 1, 1))
    below = t.quads(names, F.concat(F.lit(t.ONT + "Brand"), "b"), [t.iri_object(t.RDFS + "subClassOf", maker, t.ONTOLOGY)])
    above = t.quads(names, maker, [t.iri_object(t.RDFS + "subClassOf", F.lit(t.ONT + "Anything"), t.ONTOLOGY)])
    typed = t.quads(rows, F.concat(F.lit(f"{NODE}part/"), F.col("p_partkey").cast("string")), [t.iri_object(t.TYPE, F.concat(F.lit(t.ONT + "Brand"), "b"))])
    return t.union(below, t.as_set(above), typed)


_DIGITS = "regexp_extract(p_brand, '([0-9]+)$', 1)"


@query(f"SELECT DISTINCT 'Brand' || {_DIGITS} AS cls, 'Maker' || substr({_DIGITS}, 1, 1) AS parents FROM part UNION SELECT 'Maker' || substr({_DIGITS}, 1, 1), 'Anything' FROM part")
def class_tree_of_brands(spark, d):
    found = E.class_parents(_brands(spark, d))
    return found.select(t.local_name(F.col("iri")).alias("cls"), F.array_join(F.transform("parents", t.local_name), ",").alias("parents"))


@query(f"""SELECT DISTINCT 'Maker' || substr({_DIGITS}, 1, 1) AS root, 'Maker' || substr({_DIGITS}, 1, 1) AS path, 0 AS depth FROM part
UNION SELECT DISTINCT 'Maker' || substr({_DIGITS}, 1, 1), 'Maker' || substr({_DIGITS}, 1, 1) || '/Brand' || {_DIGITS}, 1 FROM part""")
def class_forest_of_brands(spark, d):
    """Every class at its place below a root."""
    found = E.class_forest(_brands(spark, d))
    return found.select(t.local_name(F.col("root")).alias("root"), F.array_join(F.transform("path", t.local_name), "/").alias("path"), "depth")


@query(f"SELECT 'Maker' || substr({_DIGITS}, 1, 1) AS maker, count(*) AS n FROM part GROUP BY 1")
def instances_below(spark, d):
    """Instances of each maker's class through its subclasses, by the subclass rules."""
    rows = _brands(spark, d)
    done = I.materialise(I.facts_of(rows), "rdfs").derivations
    made = done.filter((F.col("p") == TYPE) & F.col("o").contains("#Maker"))
    return made.groupBy(F.regexp_extract("o", "#(.*)>$", 1).alias("maker")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT 'Brand' || {_DIGITS} AS cls FROM part WHERE substr({_DIGITS}, 1, 1) = '1' UNION SELECT 'Maker1' FROM part WHERE substr({_DIGITS}, 1, 1) = '1'")
def descendants_of_maker(spark, d):
    rows = _brands(spark, d)
    return E.descendants(rows, t.ONT + "Maker1").select(t.local_name(F.col("iri")).alias("cls"))


@query("SELECT n_name AS nation, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS found FROM nation")
def ask_for_each(spark, d):
    """ASK { ?s inNation ?n } for every nation at once."""
    rows = kg(spark, d, "nation", "supplier")
    asked = A.bgp(rows, [("?n", TYPE, p("Nation")), ("?n", LABEL, "?name")])
    hits = A.match(kg(spark, d, "supplier"), ("?s", p("inNation"), "?n")).select("n").distinct().withColumn("hit", F.lit(True))
    return asked.join(hits, "n", "left").select(lex("name").alias("nation"), F.coalesce("hit", F.lit(False)).alias("found"))


@query("""
SELECT c_nationkey AS nation, count(*) * count(*) AS same, count(*) * count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1 HAVING count(*) > 1""")
def same_as_classes(spark, d):
    """The customers of a nation are said to be one, in a chain: the pairs and values that follow, counted without making them."""
    rows = table(spark, d, "customer")
    key = lambda c: F.concat(F.lit(f"<{NODE}customer/"), c.cast("string"), F.lit(">"))
    chain = rows.select("c_nationkey", "c_custkey", F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("next")).filter("next is not null")
    same = chain.select(key(F.col("c_custkey")).alias("s"), F.lit(f"<{t.OWL}sameAs>").alias("p"), key(F.col("next")).alias("o"))
    facts = I.facts_of(kg(spark, d, "customer").filter(F.col("p") == t.ONT + "segment")).union(same)
    found = M.materialise(facts)
    nation = rows.select(key(F.col("c_custkey")).alias("node"), F.col("c_nationkey").alias("nation"))
    sizes = found.classes.join(nation, "node").groupBy("component", "nation").agg(F.count("*").alias("n"))
    values = found.facts.filter(F.col("p") == p("segment")).groupBy(F.col("s").alias("component")).agg(F.count("*").alias("k"))
    return sizes.join(values, "component").select("nation", (F.col("n") * F.col("n")).alias("same"), (F.col("n") * F.col("k")).alias("segments"))


@query("SELECT 'Customer' AS cls, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Nation', count(*) FROM nation")
def instance_counts(spark, d):
    found = E.instance_counts(kg(spark, d, "customer", "supplier", "nation"))
    return found.select(t.local_name(F.col("cls")).alias("cls"), "n")


@query("SELECT 'segment' AS label, count(*) AS n FROM customer UNION ALL SELECT 'inRegion', count(*) FROM nation")
def candidate_properties(spark, d):
    """The properties that suit a class, and how often the graph of the tables uses each."""
    used = kg(spark, d, "customer", "nation").groupBy(t.local_name(F.col("p")).alias("label")).agg(F.count("*").alias("n"))
    found = E.candidate_properties(ontology(spark), t.ONT + "Customer").select("label")
    return found.join(used, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT cls, {_INSTANCES} FROM (VALUES ('Thing'), ('Party'), ('Customer'), ('Supplier')) v(cls)")
def descendants(spark, d):
    found = _with_instances(E.descendants(ontology(spark), t.ONT + "Thing"), spark, d)
    return found.select(t.local_name(F.col("iri")).alias("cls"), "n")


@query("SELECT count(*) FILTER (c_custkey % 7 = 0) AS n FROM customer")
def range_mismatch(spark, d):
    """Every seventh customer is said to be in a region, where a nation is asked for."""
    rows = kg(spark, d, "region", "nation", "customer")
    wrong = (F.col("p") == t.ONT + "inNation") & (F.regexp_extract("s", r"(\d+)$", 1).cast("long") % 7 == 0)
    rows = rows.withColumn("o", F.when(wrong, node("region", 1)).otherwise(F.col("o")))
    rows = rows.withColumn("o_key", F.when(wrong, t.iri_key(F.col("o"))).otherwise(F.col("o_key")))
    return E.range_mismatch(rows.unionByName(ontology(spark))).agg(F.count("*").alias("n"))


@query("SELECT 'Company' AS cls, count(*) AS n FROM supplier UNION ALL SELECT 'Customer', count(*) FROM customer")
def rename_term(spark, d):
    rows = E.rename_term(kg(spark, d, "customer", "supplier").unionByName(ontology(spark)), t.ONT + "Supplier", t.ONT + "Company")
    return E.instance_counts(rows).select(t.local_name(F.col("cls")).alias("cls"), "n")


@query("SELECT (count(*) * 6 - count(*) FILTER (c_nationkey = 7))::BIGINT AS n FROM customer")
def entity_delete(spark, d):
    rows = E.delete_entity(kg(spark, d, "customer", "nation"), node("nation", 7))
    return rows.filter(F.col("s").contains("/customer/")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS customer, CASE WHEN c_custkey = 3 THEN 'renamed' ELSE c_name END AS name FROM customer")
def entity_patch(spark, d):
    rows = E.set_value(kg(spark, d, "customer"), node("customer", 3), t.LABEL, "renamed")
    return A.match(rows, ("?customer", LABEL, "?name")).select(key_of("customer").alias("customer"), lex("name"))


@query("SELECT 'https://kg.example/id/nation/' || n_nationkey AS iri, n_name AS label, 'Nation' AS types FROM nation")
def entity_cards(spark, d):
    found = E.entity_cards(kg(spark, d, "nation"))
    return found.select("iri", "label", F.array_join(F.transform("types", t.local_name), ",").alias("types"))


@query("SELECT n_nationkey AS nation, CASE WHEN n_regionkey = 1 THEN 0 ELSE 4 END::BIGINT AS n FROM nation WHERE n_regionkey <> 1")
def graph_update(spark, d):
    """DELETE WHERE: what is said of the nations of one region goes."""
    rows = kg(spark, d, "nation")
    gone = rows.join(rows.filter((F.col("p") == t.ONT + "inRegion") & (F.col("o") == node("region", 1))).select("s"), "s", "left_semi").select(*rows.columns)
    return E.delete(rows, gone).groupBy("s").agg(F.count("*").alias("n")).select(F.regexp_extract("s", r"(\d+)$", 1).cast("int").alias("nation"), "n")


@query("SELECT 'urn:kg:copy' AS g, count(*) * 4 AS n FROM nation")
def graph_move(spark, d):
    return A.counts(E.copy_graph(kg(spark, d, "nation"), t.DATA, "urn:kg:copy", move=True))


# edge metadata


@query("""
SELECT 'urn:kg:data' AS g, 'label' AS p, (SELECT count(*) FROM customer) AS n, 1::BIGINT AS seq UNION ALL SELECT 'urn:kg:data', 'inNation', (SELECT count(*) FROM customer), 1
UNION ALL SELECT 'urn:kg:places', 'label', (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0), 3 UNION ALL SELECT 'urn:kg:places', 'inRegion', (SELECT count(*) FROM nation), 3""")
def store_graphs(spark, d):
    """Two graphs in a store; one of them is replaced and then changed, and the other is left as it lies."""
    store = QuadStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex[:12]}")
    store.replace(kg(spark, d, "customer"), [t.DATA])
    places = kg(spark, d, "nation").withColumn("g", F.lit("urn:kg:places"))
    store.replace(places.filter(F.col("p") == t.LABEL), ["urn:kg:places"])
    odd = (F.col("p") == t.LABEL) & (F.regexp_extract("s", r"(\d+)$", 1).cast("long") % 2 == 1)
    store.change("urn:kg:places", add=places.filter(F.col("p") == t.ONT + "inRegion"), remove=places.filter(odd))
    asked = store.read().filter(F.col("p").isin(t.LABEL, t.ONT + "inNation", t.ONT + "inRegion"))
    counts = asked.groupBy("g", t.local_name(F.col("p")).alias("p")).agg(F.count("*").alias("n"))
    return counts.join(store.current().select(F.col("graph").alias("g"), "seq"), "g").select("g", "p", "n", "seq")


def _annotated(spark, d):
    rows = kg(spark, d, "customer").filter(F.col("p") == t.ONT + "inNation")
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("long")
    return E.annotate(rows.select("s", "p", "o_key"), {t.ONT + "confidence": F.when(number % 2 == 0, (number % 10) / 10.0), t.ONT + "by": F.when(number % 2 == 0, F.lit("loader"))})


@query("SELECT c_custkey AS customer, ((c_custkey % 10) / 10.0)::VARCHAR AS confidence, 'loader' AS actor FROM customer WHERE c_custkey % 2 = 0")
def edge_metadata(spark, d):
    found = E.annotations(_annotated(spark, d), [t.ONT + "confidence", t.ONT + "by"])
    return found.select(F.regexp_extract("s", r"(\d+)$", 1).cast("long").alias("customer"), "confidence", F.col("by").alias("actor"))


@query("SELECT c_custkey AS customer, c_nationkey AS nation FROM customer WHERE c_custkey % 2 = 0")
def triple_term_match(spark, d):
    found = A.quoted(_annotated(spark, d)).filter(F.col("via") == f"<{t.REIFIES}>")
    return found.select(key_of("s").alias("customer"), key_of("o", "int").alias("nation"))


# validation


def _facts(spark, d):
    """Customers with negative balances stored as text, every seventh in a region."""
    rows = kg(spark, d, "customer", "nation", "region")
    # by value: the text of a zero may have a sign
    negative = (F.col("p") == t.ONT + "acctbal") & (F.col("o").try_cast("double") < 0)
    wrong = (F.col("p") == t.ONT + "inNation") & (F.regexp_extract("s", r"(\d+)$", 1).cast("long") % 7 == 0)
    key = F.when(negative, t.literal_key(F.col("o"), F.lit(None).cast("string"), F.lit(None).cast("string"))).when(wrong, f"<{node('region', 1)}>").otherwise(F.col("o_key"))
    return I.facts_of(rows.withColumn("o_key", key).unionByName(ontology(spark)))


def _shape(*properties: S.Property, **more) -> list[S.Shape]:
    return [S.Shape("customer", t.ONT + "Party", list(properties), **more)]


def _findings(found):
    return found.select(key_of("focus").alias("customer"), F.regexp_replace("constraint", "ConstraintComponent", "").alias("constraint"))


def _orders(spark, d, only=None):
    rows = table(spark, d, "orders")
    rows = rows if only is None else rows.filter(only)
    key = lambda name, c: F.concat(F.lit(f"<{NODE}{name}/"), F.col(c).cast("string"), F.lit(">"))
    placed = rows.select(key("customer", "o_custkey").alias("s"), F.lit(p("placed")).alias("p"), key("orders", "o_orderkey").alias("o"))
    return I.facts_of(kg(spark, d, "customer").unionByName(ontology(spark))).union(placed)


@query("SELECT c_custkey AS customer, 'MinCount' AS constraint FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def shacl_min(spark, d):
    return _findings(S.validate(_orders(spark, d, F.col("o_orderpriority") == "1-URGENT"), _shape(S.Property(t.ONT + "placed", min_count=1))))


@query("SELECT o_custkey AS customer, 'MaxCount' AS constraint FROM orders GROUP BY 1 HAVING count(*) > 12")
def shacl_max(spark, d):
    return _findings(S.validate(_orders(spark, d), _shape(S.Property(t.ONT + "placed", max_count=12))))


@query("SELECT c_custkey AS customer, 'Datatype' AS constraint FROM customer WHERE c_acctbal < 0")
def shacl_datatype(spark, d):
    return _findings(S.validate(_facts(spark, d), _shape(S.Property(t.ONT + "acctbal", datatype=t.XSD + "decimal"))))


@query("SELECT c_custkey AS customer, 'Class' AS constraint FROM customer WHERE c_custkey % 7 = 0")
def shacl_class(spark, d):
    return _findings(S.validate(_facts(spark, d), _shape(S.Property(t.ONT + "inNation", cls=t.ONT + "Nation"))))


@query("SELECT c_custkey AS customer, 'NodeKind' AS constraint FROM customer UNION ALL SELECT c_custkey, 'Class' FROM customer")
def shacl_nodekind(spark, d):
    return _findings(S.validate(_facts(spark, d), _shape(S.Property(t.ONT + "segment", cls=t.ONT + "Nation"))))


@query("SELECT c_custkey AS customer, 'Pattern' AS constraint FROM customer WHERE NOT regexp_matches(c_name, '[1-5]$')")
def shacl_pattern(spark, d):
    return _findings(S.validate(_facts(spark, d), _shape(S.Property(t.LABEL, pattern="[1-5]$"))))


@query("SELECT c_custkey AS customer, 'Closed' AS constraint FROM customer UNION ALL SELECT c_custkey, 'Closed' FROM customer")
def shacl_closed(spark, d):
    asked = [S.Property(x) for x in (t.LABEL, t.EXTERNAL_KEY, t.ONT + "inNation")]
    return _findings(S.validate(_facts(spark, d), _shape(*asked, closed=True, ignore_type=True)))


@query("SELECT c_custkey AS customer, CASE WHEN c_acctbal < 0 THEN 'MinInclusive' END AS constraint FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'In' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def shacl_values(spark, d):
    asked = [S.Property(t.ONT + "acctbal", min_inclusive=0), S.Property(t.ONT + "segment", one_of=('"BUILDING"', '"MACHINERY"'))]
    return _findings(S.validate(_facts(spark, d), _shape(*asked)))


@query(f"""SELECT '<{NODE}customer/' || c_custkey || '>' AS focus, '{t.ONT}acctbal' AS path, 'MinInclusiveConstraintComponent' AS constraint,
'"' || c_acctbal::DECIMAL(20, 2)::VARCHAR || '"^^<{t.XSD}decimal>' AS value, 'Warning' AS severity, 'in debt' AS message FROM customer WHERE c_acctbal < 0
UNION ALL SELECT '<{NODE}customer/' || c_custkey || '>', '{t.ONT}nothing', 'MinCountConstraintComponent', NULL, 'Violation', 'MinCountConstraintComponent: nothing' FROM customer""")
def shacl_messages(spark, d):
    """Focus, path, value, severity and message of each finding, of a shape that was saved as quads and loaded."""
    asked = [S.Property(t.ONT + "acctbal", min_inclusive=0.0, severity="Warning", message="in debt"), S.Property(t.ONT + "nothing", min_count=1)]
    rows = S.save(S.save(ontology(spark), S.Shape("debt", t.ONT + "Other")), S.Shape("debt", t.ONT + "Customer", asked))
    facts = _facts(spark, d)
    money = F.concat(F.lit('"'), F.format_string("%.2f", A.text(F.col("o")).try_cast("double")), F.lit(f'"^^<{t.XSD}decimal>'))
    facts = facts.withColumn("o", F.when(F.col("p") == p("acctbal"), money).otherwise(F.col("o")))
    return S.validate(facts, S.load(rows)).select("focus", "path", "constraint", "value", "severity", "message")


@query("SELECT c_custkey AS customer, 'HasValue' AS constraint FROM customer WHERE c_mktsegment <> 'BUILDING'")
def shacl_has_value(spark, d):
    return _findings(S.validate(_facts(spark, d), _shape(S.Property(t.ONT + "segment", has_value='"BUILDING"'))))


@query("SELECT false AS conforms, 1::BIGINT AS shapes, (count(*) FILTER (c_acctbal < 0) + count(*) FILTER (c_custkey % 7 = 0))::BIGINT AS findings, count(*) FILTER (c_acctbal < 0 OR c_custkey % 7 = 0) AS nodes FROM customer")
def shacl_report(spark, d):
    shapes = _shape(S.Property(t.ONT + "acctbal", datatype=t.XSD + "decimal"), S.Property(t.ONT + "inNation", cls=t.ONT + "Nation", severity="Warning"))
    return S.report(S.validate(_facts(spark, d), shapes), shapes)


def _party_shapes() -> list[S.Shape]:
    """Customers are well off or in building, not both, not in debt, and live in a nation of one region."""
    return [
        S.Shape("rich", None, [S.Property(t.ONT + "acctbal", min_inclusive=5000.0)]),
        S.Shape("builder", None, [S.Property(t.ONT + "segment", has_value='"BUILDING"')]),
        S.Shape("debtor", None, [S.Property(t.ONT + "acctbal", max_exclusive=0.0)]),
        S.Shape("near", None, [S.Property(t.ONT + "inRegion", one_of=(f"<{node('region', 1)}>", f"<{node('region', 2)}>"), min_count=1)]),
        S.Shape("nearby", None, [S.Property(S.SELF, all_of=("near",), node_kind="IRI")]),
        S.Shape("client", t.ONT + "Customer", [
            S.Property(S.SELF, any_of=("rich", "builder"), none_of=("debtor",)), S.Property(S.SELF, just_one_of=("rich", "builder")), S.Property(t.ONT + "inNation", node=("nearby",)),
        ]),
    ]


_LOGIC = """
WITH c AS (SELECT *, c_acctbal >= 5000 AS rich, c_mktsegment = 'BUILDING' AS builder FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey AS customer, 'Or' AS constraint FROM c WHERE NOT rich AND NOT builder UNION ALL SELECT c_custkey, 'Not' FROM c WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'Xone' FROM c WHERE rich = builder UNION ALL SELECT c_custkey, 'Node' FROM c WHERE n_regionkey NOT IN (1, 2)"""


def _plain_facts(spark, d, *names):
    return I.facts_of(kg(spark, d, *names).unionByName(ontology(spark)))


@query(_LOGIC)
def shacl_logic(spark, d):
    """Nested shapes: or, not, exactly one, and a shape of a shape of each value."""
    return _findings(S.validate(_plain_facts(spark, d, "customer", "nation"), _party_shapes()))


@query(_LOGIC)
def shape_roundtrip(spark, d):
    """The same shapes after they were saved as quads and loaded."""
    rows = ontology(spark)
    for shape in _party_shapes():
        rows = S.save(rows, shape)
    return _findings(S.validate(_plain_facts(spark, d, "customer", "nation"), S.load(rows)))


@query("""
WITH n AS (SELECT c_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey AS customer, 'QualifiedMinCount' AS constraint FROM n WHERE n < 1 UNION ALL SELECT c_custkey, 'QualifiedMaxCount' FROM n WHERE n > 3""")
def shacl_qualified(spark, d):
    """Between one and three of a customer's orders, which lie at the other end of a link, are urgent."""
    shapes = [
        S.Shape("urgent", None, [S.Property(t.ONT + "priority", has_value='"1-URGENT"')]),
        S.Shape("client", t.ONT + "Customer", [S.Property(("inverse", t.ONT + "placedBy"), qualified="urgent", qualified_min=1, qualified_max=3)]),
    ]
    return _findings(S.validate(_plain_facts(spark, d, "customer", "orders"), shapes))


@query("""
WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey AS customer, 'LessThan' AS constraint FROM c WHERE NOT c_acctbal < c_nationkey * 400
UNION ALL SELECT c_custkey, 'Equals' FROM c WHERE n_regionkey <> c_custkey % 5 UNION ALL SELECT c_custkey, 'Equals' FROM c WHERE n_regionkey <> c_custkey % 5
UNION ALL SELECT c_custkey, 'Disjoint' FROM c WHERE n_regionkey = c_custkey % 5""")
def shacl_pairs(spark, d):
    """Values of a path against those of another predicate: below them, the same, none in common."""
    key = lambda name, c: F.concat(F.lit(f"<{NODE}{name}/"), c.cast("string"), F.lit(">"))
    rows = table(spark, d, "customer")
    limit = F.concat(F.lit('"'), (F.col("c_nationkey") * 400).cast("string"), F.lit(f'"^^<{t.XSD}integer>'))
    said = F.explode(F.array(F.struct(F.lit(p("limit")).alias("p"), limit.alias("o")), F.struct(F.lit(p("home")).alias("p"), key("region", F.col("c_custkey") % 5).alias("o"))))
    facts = _plain_facts(spark, d, "customer", "nation").unionByName(rows.select(key("customer", F.col("c_custkey")).alias("s"), said.alias("x")).select("s", "x.*"), allowMissingColumns=True)
    region = ("seq", t.ONT + "inNation", t.ONT + "inRegion")
    return _findings(S.validate(facts, _shape(S.Property(t.ONT + "acctbal", less_than=t.ONT + "limit"), S.Property(region, equals=t.ONT + "home"), S.Property(region, disjoint=t.ONT + "home"))))


@query("""
WITH n AS (SELECT n_regionkey AS region, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT region, 'MinCount' AS constraint FROM n WHERE n < (SELECT avg(n) FROM n) UNION ALL SELECT r_regionkey, 'HasValue' FROM region WHERE r_name <> 'ASIA'""")
def shacl_paths(spark, d):
    """Regions, found as the objects of a predicate, by the customers that lead to them and by an alternative of predicates."""
    facts = _plain_facts(spark, d, "customer", "nation", "region")
    least = -(-table(spark, d, "customer").count() // 5)
    people = ("seq", ("inverse", t.ONT + "inRegion"), ("inverse", t.ONT + "inNation"))
    shape = S.Shape("region", properties=[S.Property(people, min_count=least), S.Property(("alt", t.LABEL, t.ONT + "alias"), has_value='"ASIA"')], target_objects_of=(t.ONT + "inRegion",))
    return S.validate(facts, [shape]).select(key_of("focus").alias("region"), F.regexp_replace("constraint", "ConstraintComponent", "").alias("constraint"))


# traversal


@query(f"""SELECT 'externalKey' AS p, '7' AS o UNION ALL SELECT 'label', n_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'type', 'https://kg.example/ont#Nation'
UNION ALL SELECT 'inRegion', '{NODE}region/' || n_regionkey FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'externalKey', n_regionkey::VARCHAR FROM nation WHERE n_nationkey = 7
UNION ALL SELECT 'label', r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = 7 UNION ALL SELECT 'type', 'https://kg.example/ont#Region'""")
def cbd_depth2(spark, d):
    return fixpoint.describe(kg(spark, d, "nation", "region"), node("nation", 7), depth=2).select(t.local_name(F.col("p")).alias("p"), "o")


@query("SELECT 0 AS level, 1::BIGINT AS n UNION ALL SELECT 1, count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 2, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def bfs_levels(spark, d):
    rows = kg(spark, d, "customer", "nation", "region")
    edges = fixpoint.incident(rows, t.TYPE).select("a", "b")
    start = spark.createDataFrame([(node("region", 1),)], "start string")
    return fixpoint.levels(edges, start, 2).groupBy("level").agg(F.count("*").alias("n"))


@query(f"SELECT node, level FROM (SELECT '{NODE}region/1' AS node, 0 AS level UNION ALL SELECT '{NODE}nation/' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '{NODE}customer/' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) ORDER BY level, node LIMIT 50")
def neighbours_cap(spark, d):
    return fixpoint.neighbourhood(kg(spark, d, "customer", "nation", "region"), node("region", 1), t.TYPE, depth=2, most=50)[0]


@query("SELECT CASE WHEN a.n_nationkey = b.n_nationkey THEN 2 WHEN a.n_regionkey = b.n_regionkey THEN 4 ELSE -1 END::BIGINT AS steps FROM customer x JOIN nation a ON x.c_nationkey = a.n_nationkey, customer y JOIN nation b ON y.c_nationkey = b.n_nationkey WHERE x.c_custkey = 1 AND y.c_custkey = 2")
def shortest_path_len(spark, d):
    found = fixpoint.shortest_path(kg(spark, d, "customer", "nation", "region"), node("customer", 1), node("customer", 2), t.TYPE)
    if found is None:
        return spark.createDataFrame([(-1,)], "steps long")
    return found.agg(F.count("*").alias("steps"))
