"""Queries over search, the change log and the property-graph view, with the SQL they equal."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators import changelog as C
from ..operators import property_graph as G
from ..operators import search as R
from ..operators.fixpoint import cut
from ..operators.text_index import TextIndex
from ..sources import nquads
from ..storage import Tables, parts_of, shared_dir
from ..streaming import feed
from .graph import kg, table
from .registry import registry

QUERIES, SQL, query = registry()
CUSTOMER_IRI = "'https://kg.example/id/customer/' || c_custkey"


# search


def _parts(spark, d):
    return R.records(kg(spark, d, "part"))


_PART = "'https://kg.example/id/part/' || p_partkey AS iri, p_name AS label"


_BM25 = f"""WITH f AS (SELECT {_PART}, (len(string_split(lower(p_name), 'red')) - 1)::DOUBLE AS f, greatest(length(p_name) - 2, 0)::DOUBLE AS d FROM part),
w AS (SELECT count(*) AS n, avg(d) AS a, count(*) FILTER (f > 0) AS k FROM f)
SELECT iri, label, round(-greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a)), 6) AS score FROM f, w WHERE f > 0 ORDER BY score, iri LIMIT 50"""


@query(_BM25)
def search_bm25(spark, d):
    return R.search(_parts(spark, d), "red").withColumn("score", F.round("score", 6))


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query(_BM25)
def search_index(spark, d):
    """The same ranking from postings of trigrams instead of the texts."""
    index = TextIndex(spark, _folder(spark, "index"))
    index.build(_parts(spark, d))
    return index.search("red").withColumn("score", F.round("score", 6))


@query(f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'renamed ' || p_partkey ELSE p_name END AS p_name FROM part WHERE p_partkey % 50 <> 0)
SELECT {_PART} FROM p WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'med 1') ORDER BY iri""")
def search_index_upkeep(spark, d):
    """Names change and parts go; only their entries are written again, and then all segments are merged."""
    recs = Tables(spark, "records").cut(_parts(spark, d))  # indexed and changed below
    number = F.regexp_extract("iri", r"(\d+)$", 1)
    index = TextIndex(spark, _folder(spark, "index"))
    index.build(recs)
    touched = recs.filter(number.cast("long") % 10 == 0).select("iri")
    fresh = recs.filter(number.cast("long") % 50 != 0).withColumn("label", F.when(number.cast("long") % 10 == 0, F.concat(F.lit("renamed "), number)).otherwise(F.col("label")))
    index.update(fresh, touched)
    before = index.search("red", limit=None).select("iri", "label")
    index.merge()
    return before.union(index.search("med 1", limit=None).select("iri", "label")).distinct()


@query(f"SELECT {_PART} FROM part WHERE contains(lower(p_name), 're') ORDER BY iri LIMIT 500")
def search_short(spark, d):
    return R.search(_parts(spark, d), "RE", limit=500).select("iri", "label")


@query(f"SELECT {_PART} FROM part ORDER BY iri LIMIT 20 OFFSET 30")
def search_page(spark, d):
    return R.search(_parts(spark, d), "", limit=20, offset=30).select("iri", "label")


@query("SELECT 'entity' AS kind, 'Part' AS cls, count(*) AS n FROM part UNION ALL SELECT 'entity', 'Nation', count(*) FROM nation")
def search_kind(spark, d):
    recs = R.records(kg(spark, d, "part", "nation"))
    found = R.select(recs, kind="entity").select("kind", t.local_name(F.element_at("types", 1)).alias("cls"))
    return found.groupBy("kind", "cls").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n, round(sum(x[1]::DOUBLE), 6) AS first FROM (SELECT label, embedding AS x FROM embeddings) GROUP BY 1")
def embedding_sums(spark, d):
    found = table(spark, d, "embeddings").groupBy("label")
    return found.agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("embedding", 1).cast("double")), 6).alias("first"))


@query("""WITH l AS (SELECT DISTINCT lower(p_name) AS x FROM part WHERE p_name <> ''),
g AS (SELECT x, substr(x, i::BIGINT, 2) AS gram FROM l, unnest(range(1, greatest(length(x), 2))) u(i) UNION ALL SELECT x, substr(x, i::BIGINT, 3) FROM l, unnest(range(1, greatest(length(x) - 1, 2))) u(i)),
c AS (SELECT x, gram, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2), z AS (SELECT x, sqrt(sum(n * n)) AS z FROM c GROUP BY 1),
w AS (SELECT x, gram, n / z AS w FROM c JOIN z USING (x))
SELECT a.x AS a, b.x AS b, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b ON a.gram = b.gram AND a.x < b.x GROUP BY 1, 2 HAVING sum(a.w * b.w) > 0.5""")
def near_duplicate_labels(spark, d):
    """Pairs of distinct labels (a vocabulary of names, not of rows) with similar n-grams."""
    labels = table(spark, d, "part").filter("p_name <> ''").select(F.lower("p_name").alias("iri")).distinct()
    scores = R.similar_pairs(R.gram_cosine(labels.withColumn("text", F.col("iri"))), 0.5)
    return scores.select("a", "b", F.round("score", 6).alias("score"))


@query()
def embedding_hashed_search(spark, d):
    """Labels nearest to one label by hashed n-grams; the hash has no SQL form."""
    labels = table(spark, d, "part").select(F.col("p_name").alias("iri")).distinct()
    vectors = cut(R.embed(labels.withColumn("text", F.col("iri"))))
    asked = R.embed(spark.createDataFrame([("q", "red steel")], "iri string, text string"))
    return R.similar(vectors, asked, limit=10).withColumn("score", F.round("score", 4))


# change log: an event is a change of its user's node

_LOG = "SELECT event_id AS seq, user_id::VARCHAR AS actor, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'A' ELSE 'D' END AS op, user_id AS k, ts FROM events"


def _log(spark, d):
    op = F.when(F.col("event_type").isin("click", "view", "signup"), "A").otherwise("D")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("actor"), op.alias("op"), F.col("user_id").alias("k"), "ts")


@query(f"SELECT seq, actor, count(*) FILTER (op = 'A') AS additions, count(*) FILTER (op = 'D') AS deletions FROM ({_LOG}) GROUP BY 1, 2 ORDER BY seq DESC LIMIT 50")
def log_history(spark, d):
    return C.history(_log(spark, d))


@query(f"SELECT actor, count(DISTINCT seq) AS patches, count(*) AS changes FROM ({_LOG}) GROUP BY 1")
def log_actors(spark, d):
    return C.actors(_log(spark, d))


@query(f"SELECT count(*) AS n FROM ({_LOG}) WHERE seq > 100 AND seq <= 400")
def log_range(spark, d):
    return C.between(_log(spark, d), 100, 400).agg(F.count("*").alias("n"))


@query(f"SELECT k FROM ({_LOG}) WHERE seq <= 500 GROUP BY k HAVING max_by(op, seq) = 'A'")
def restore_at_seq(spark, d):
    return C.restore(_log(spark, d), ["k"], 500)


@query(f"SELECT k FROM ({_LOG}) WHERE seq <= 900 GROUP BY k HAVING max_by(op, seq) = 'A'")
def restore_from_snapshot(spark, d):
    """The state at a patch from the state at an earlier one and what lies between."""
    log = _log(spark, d)
    return C.restore(log, ["k"], 900, snapshot=C.restore(log, ["k"], 400), snapshot_seq=400)


@query(f"""WITH a AS (SELECT k FROM ({_LOG}) WHERE seq <= 300 GROUP BY k HAVING max_by(op, seq) = 'A'), b AS (SELECT k FROM ({_LOG}) WHERE seq <= 800 GROUP BY k HAVING max_by(op, seq) = 'A')
SELECT 'A' AS op, k FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT 'D', k FROM a WHERE k NOT IN (SELECT k FROM b)""")
def patch_diff(spark, d):
    log = _log(spark, d)
    return C.diff(C.restore(log, ["k"], 300), C.restore(log, ["k"], 800), ["k"])


@query(f"SELECT k FROM ({_LOG}) WHERE seq <= 299 GROUP BY k HAVING max_by(op, seq) = 'A'")
def undo_state(spark, d):
    """The net effect of one patch is undone by its inverse."""
    log = _log(spark, d)
    before = C.restore(log, ["k"], 299)
    patch = C.net(before, log.filter("seq = 300").select("seq", "op", "k"), ["k"])
    after = C.apply(before, patch, ["k"])
    return C.apply(after, C.invert(patch, 301), ["k"])


@query(f"SELECT seq, actor, op, 'k ' || k AS statement FROM ({_LOG})")
def patch_text(spark, d):
    """Patch text and back; a patch is a file here."""
    log = _log(spark, d).withColumn("statement", F.concat(F.lit("k "), F.col("k").cast("string")))
    lines = C.serialise(log).select(F.col("seq").alias("file"), F.col("part").alias("line"), "value")
    return C.parse(lines)


@query(f"SELECT seq, actor, count(*) FILTER (op = 'A') AS additions, count(*) FILTER (op = 'D') AS deletions FROM ({_LOG}) GROUP BY 1, 2")
def change_feed(spark, d):
    """Notices of a log folder, followed as a stream until all that is there was read."""
    root = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex[:12]}"
    log = _log(spark, d)
    log.write.parquet(f"{root}/log")
    feed.follow(spark, f"{root}/log", log.schema, f"{root}/out", f"{root}/checkpoint")
    rows = spark.read.schema("seq long, actor string, additions long, deletions long, batch int").parquet(f"{root}/out")
    return rows.groupBy("seq", "actor").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


# property graph and text forms


@query(f"SELECT {CUSTOMER_IRI} AS id, c_name AS label, 'Customer' AS types, 3 AS attrs FROM customer UNION ALL SELECT 'https://kg.example/id/nation/' || n_nationkey, n_name, 'Nation', 1 FROM nation UNION ALL SELECT 'https://kg.example/id/region/' || r_regionkey, r_regionkey::VARCHAR, '', 0 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def pg_nodes(spark, d):
    found = G.nodes(kg(spark, d, "customer", "nation"))
    return found.select("id", "label", F.array_join(F.transform("types", t.local_name), ";").alias("types"), F.size("attrs").alias("attrs"))


@query(f"SELECT {CUSTOMER_IRI} AS source, 'inNation' AS predicate, 'https://kg.example/id/nation/' || c_nationkey AS target FROM customer")
def pg_edges(spark, d):
    return G.edges(kg(spark, d, "customer")).select("source", t.local_name(F.col("predicate")).alias("predicate"), "target")


@query("""WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
SELECT id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT a AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT b, 0, 1 FROM e) GROUP BY 1""")
def degree(spark, d):
    found = G.degrees(kg(spark, d, "customer", "nation"))
    short = F.concat(F.substring(F.regexp_extract("id", r"/(\w)\w*/\d+$", 1), 1, 1), F.regexp_extract("id", r"(\d+)$", 1))
    return found.select(short.alias("id"), "outgoing", "incoming")


@query("SELECT (SELECT count(*) FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) AS language_tagged, 0::BIGINT AS with_triples, 1::BIGINT AS graphs")
def loss_report(spark, d):
    docs = table(spark, d, "documents")
    rows = t.quads(docs, F.concat(F.lit(t.ID), F.col("doc_id").cast("string")), [t.literal_object(t.ONT + "source", F.col("source"), lang=F.col("lang"))])
    return G.loss(rows)


@query("""SELECT '<https://kg.example/id/region/' || r_regionkey || '> <http://www.w3.org/2000/01/rdf-schema#label> "' || r_name || '" <urn:kg:data> .' AS value FROM region
UNION ALL SELECT '<https://kg.example/id/region/' || r_regionkey || '> <https://kg.example/ont#externalKey> "' || r_regionkey || '" <urn:kg:data> .' FROM region
UNION ALL SELECT '<https://kg.example/id/region/' || r_regionkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <https://kg.example/ont#Region> <urn:kg:data> .' FROM region""")
def nquads_lines(spark, d):
    return nquads.lines(kg(spark, d, "region"))


@query("SELECT count(*) * 6 AS n, 0::BIGINT AS lost FROM customer")
def nquads_roundtrip(spark, d):
    rows, parts = kg(spark, d, "customer"), parts_of(table(spark, d, "customer"), 50_000)
    back = nquads.parse(nquads.lines(rows), parts=parts)
    key = ["g", "s", "p", "o_key", "o", "dt"]
    side = lambda x, n, given: x.withColumn("dt", F.coalesce("o_dt", F.lit(""))).select(*key, F.lit(n).alias("n"), F.lit(given).alias("given"))
    both = side(back, 1, 0).union(side(rows, 0, 1)).repartition(parts, *key).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("given").alias("given"))
    return both.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") == 0, F.col("given")).otherwise(0)).alias("lost"))


@query(f"SELECT {CUSTOMER_IRI} AS \":ID\", c_name AS label, 'Customer' AS \":LABEL\", c_custkey::VARCHAR AS \"externalKey\", c_mktsegment AS segment FROM customer")
def pg_node_csv(spark, d):
    """Nodes with a column for each attribute."""
    return G.node_csv(kg(spark, d, "customer")).filter(F.col(":LABEL") != "").drop("acctbal")


_PLACES = """n AS (SELECT 'https://kg.example/id/nation/' || n_nationkey AS id, n_name AS label, 'https://kg.example/ont#Nation' AS types FROM nation
UNION ALL SELECT 'https://kg.example/id/region/' || r_regionkey, r_name, 'https://kg.example/ont#Region' FROM region),
e AS (SELECT 'https://kg.example/id/nation/' || n_nationkey AS source, 'https://kg.example/id/region/' || n_regionkey AS target FROM nation)"""


@query(f"""WITH {_PLACES}, i AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM n)
SELECT 0 AS part, 'graph LR' AS line UNION ALL SELECT 1, 'n' || i || '["' || label || '"]' FROM i WHERE i < 20
UNION ALL SELECT 2, 'n' || a.i || ' -->|inRegion| n' || b.i FROM e JOIN i a ON a.id = source JOIN i b ON b.id = target WHERE a.i < 20 AND b.i < 20
UNION ALL SELECT 3, '%% ' || (count(*) - 20) || ' more nodes are left out' FROM i HAVING count(*) > 20""")
def mermaid_lines(spark, d):
    """A flow chart of the first twenty nodes."""
    return G.mermaid(kg(spark, d, "nation", "region"), 20)


@query(f"""WITH {_PLACES} SELECT 1 AS part, '<node id="' || id || '"><data key="label">' || label || '</data><data key="types">' || types || '</data><data key="externalKey">' || regexp_extract(id, '[^/]+$') || '</data></node>' AS line FROM n
UNION ALL SELECT 2, '<edge source="' || source || '" target="' || target || '"><data key="predicate">https://kg.example/ont#inRegion</data></edge>' FROM e
UNION ALL SELECT 3, '</graph></graphml>'""")
def graphml_lines(spark, d):
    return G.graphml(kg(spark, d, "nation", "region")).filter("part > 0")


@query("SELECT 'https://kg.example/id/region/' || r_regionkey AS id, r_name AS label FROM region")
def jsonld_documents(spark, d):
    found = G.documents(kg(spark, d, "region"))
    label = F.regexp_extract("json", r'rdf-schema#label":\[\{"@value":"([^"]*)"', 1)
    return found.select("id", label.alias("label"))
