"""The graph that the queries of this folder ask: mappings of the tables and an ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..sources.mapping import Field, Mapping, ingest

MAPPINGS = {
    "region": Mapping("region", ["r_regionkey"], ["Region"], "r_name", unique=True),
    "nation": Mapping("nation", ["n_nationkey"], ["Nation"], "n_name", [Field("n_regionkey", "inRegion", "link", target="region")], unique=True),
    "customer": Mapping(
        "customer", ["c_custkey"], ["Customer"], "c_name",
        [Field("c_acctbal", "acctbal", datatype="decimal"), Field("c_mktsegment", "segment", datatype="string"), Field("c_nationkey", "inNation", "link", target="nation")], unique=True,
    ),
    "supplier": Mapping(
        "supplier", ["s_suppkey"], ["Supplier"], "s_name",
        [Field("s_acctbal", "acctbal", datatype="decimal"), Field("s_nationkey", "inNation", "link", target="nation")], unique=True,
    ),
    "part": Mapping(
        "part", ["p_partkey"], ["Part"], "p_name",
        [Field("p_brand", "brand", "reference"), Field("p_type", "type", datatype="string"), Field("p_size", "size"), Field("p_retailprice", "price", datatype="decimal")], unique=True,
    ),
    "orders": Mapping(
        "orders", ["o_orderkey"], ["Order"], None,
        [Field("o_orderstatus", "status", datatype="string"), Field("o_totalprice", "total", datatype="decimal"), Field("o_orderpriority", "priority", datatype="string"), Field("o_custkey", "placedBy", "link", target="customer")], unique=True,
    ),
    # no two rows agree in these six columns
    "lineitem": Mapping(
        "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"], ["LineItem"], None,
        [Field("l_quantity", "quantity", datatype="decimal"), Field("l_orderkey", "ofOrder", "link", target="orders")], unique=True,
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kg(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """Quads of the named tables; their nodes are disjoint, so the union is a set."""
    return t.union(*[ingest(table(spark, folder, n), MAPPINGS[n]) for n in names])


def node(name: str, key: object) -> str:
    return f"{t.ID}{name}/{key}"


def p(name: str) -> str:
    """Key of a property or class of the ontology."""
    return f"<{t.ONT}{name}>"


#: Facts about classes and properties: subject, predicate, object.
AXIOMS = [
    ("Customer", t.RDFS + "subClassOf", t.ONT + "Party"), ("Supplier", t.RDFS + "subClassOf", t.ONT + "Party"),
    ("Party", t.RDFS + "subClassOf", t.ONT + "Thing"), ("Region", t.TYPE, t.OWL + "Class"), ("Nation", t.TYPE, t.OWL + "Class"),
    ("inNation", t.RDFS + "subPropertyOf", t.ONT + "locatedIn"), ("inRegion", t.RDFS + "subPropertyOf", t.ONT + "locatedIn"),
    ("locatedIn", t.TYPE, t.OWL + "TransitiveProperty"), ("inNation", t.TYPE, t.OWL + "ObjectProperty"),
    ("inRegion", t.TYPE, t.OWL + "ObjectProperty"), ("segment", t.TYPE, t.OWL + "DatatypeProperty"),
    ("inNation", t.RDFS + "domain", t.ONT + "Party"), ("segment", t.RDFS + "domain", t.ONT + "Customer"),
    ("inNation", t.RDFS + "range", t.ONT + "Nation"),
]


def ontology(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(t.ONT + s, q, o) for s, q, o in AXIOMS], "s string, p string, o string")
    return t.quads(rows.select(F.col("s").alias("x"), F.col("p").alias("q"), F.col("o").alias("y")), F.col("x"), [t.iri_object(F.col("q"), F.col("y"), t.ONTOLOGY)])
