"""Queries over formats, snapshots, entities and dense vectors, with the SQL they equal."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import terms as t
from ..operators import algebra as A
from ..operators import changelog as C
from ..operators import entities as N
from ..operators import graph_edit as E
from ..operators import inference as I
from ..operators import search as R
from ..operators import snapshots
from ..operators.fixpoint import cut
from ..sources import jsonld, rdfxml, turtle, vocabulary
from ..storage import parts_of, shared_dir
from .graph import kg, node, ontology, p, table
from .history import _LOG, _log
from .patterns import NODE
from .registry import registry

QUERIES, SQL, query = registry()


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_NATIONS = f"""SELECT '<{NODE}nation/' || n_nationkey || '>' AS s, '<{t.TYPE}>' AS p, '<{t.ONT}Nation>' AS o FROM nation
UNION ALL SELECT '<{NODE}nation/' || n_nationkey || '>', '<{t.EXTERNAL_KEY}>', '"' || n_nationkey || '"' FROM nation
UNION ALL SELECT '<{NODE}nation/' || n_nationkey || '>', '<{t.LABEL}>', '"' || n_name || '"' FROM nation
UNION ALL SELECT '<{NODE}nation/' || n_nationkey || '>', '{p("inRegion")}', '<{NODE}region/' || n_regionkey || '>' FROM nation"""


def _keys(rows):
    return rows.select(t.node_key(F.col("s"), F.col("s_kind")).alias("s"), t.iri_key(F.col("p")).alias("p"), F.col("o_key").alias("o"))


# formats


@query(_NATIONS)
def turtle_roundtrip(spark, d):
    folder = _folder(spark, "turtle")
    turtle.write(kg(spark, d, "nation"), folder)
    return _keys(turtle.read(spark, folder))


@query(f"SELECT 'urn:kg:data' AS g, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 2")
def trig_roundtrip(spark, d):
    """Named graphs and typed literals, over all orders."""
    folder = _folder(spark, "trig")
    turtle.write(kg(spark, d, "orders"), folder, graphs=True)
    rows = turtle.read(spark, folder, graph=None).filter(F.col("p") == t.ONT + "priority")
    return rows.groupBy("g", F.col("o").alias("priority")).agg(F.count("*").alias("n"))


@query(_NATIONS)
def rdfxml_roundtrip(spark, d):
    folder = _folder(spark, "rdfxml")
    rdfxml.write(kg(spark, d, "nation"), folder)
    return _keys(rdfxml.read(spark, folder))


@query(_NATIONS)
def jsonld_roundtrip(spark, d):
    return _keys(jsonld.parse(jsonld.lines(kg(spark, d, "nation"))))


@query("SELECT c_custkey AS customer, CASE WHEN c_custkey % 2 = 0 THEN '2024' ELSE 'true' END AS note, '{\"' || c_mktsegment AS odd, c_nationkey AS nation, 3::BIGINT AS places FROM customer")
def jsonld_strings(spark, d):
    """Texts that look like numbers, truth values and objects, a context, a nested node and a list."""
    rows = table(spark, d, "customer")
    context = F.lit('{"@vocab":"https://kg.example/ont#","in":{"@id":"inNation","@type":"@id"},"places":{"@container":"@list"},"id":"@id"}')
    body = F.to_json(F.struct(
        F.concat(F.lit("https://kg.example/id/customer/"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "2024").otherwise("true").alias("note"),
        F.concat(F.lit('{"'), "c_mktsegment").alias("odd"), F.struct(F.concat(F.lit("https://kg.example/id/nation/"), "c_nationkey").alias("id"), F.lit("x").alias("seen")).alias("in"),
        F.array(F.lit("[a"), F.lit("b"), F.lit("1")).alias("places"),
    ))
    texts = rows.withColumn("body", body).select(F.concat(F.lit('{"@context":'), context, F.lit(","), F.expr("substring(body, 2)")).alias("value"))
    found = cut(jsonld.parse(texts, parts=parts_of(rows, 25_000)))  # asked several times
    one = lambda name: F.max(F.when(F.col("p") == t.ONT + name, A.text(F.col("o_key"))))
    firsts = found.filter(F.col("p") == t.RDF + "first").select("s", "o_key")
    heads = found.filter(F.col("p") == t.ONT + "places").select(F.col("s").alias("c"), F.col("o").alias("a"))
    step = found.filter(F.col("p") == t.RDF + "rest").select(F.col("s").alias("a"), F.col("o").alias("b"))
    second = heads.join(step, "a").select("c", F.col("b").alias("a"))
    cells = heads.union(second).union(second.join(step, "a").select("c", F.col("b").alias("a")))
    n = cells.join(firsts, F.col("a") == F.col("s")).filter(F.col("o_key").isin('"[a"', '"b"', '"1"')).groupBy("c").agg(F.count("*").alias("places"))
    plain = found.filter(F.col("s").contains("/customer/")).groupBy("s").agg(one("note").alias("note"), one("odd").alias("odd"), one("inNation").alias("to"))
    key = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    return plain.join(n, plain["s"] == n["c"]).select(key("s").alias("customer"), "note", "odd", key("to").cast("int").alias("nation"), "places")


@query("SELECT c_custkey AS customer, '\"' || (c_custkey % 10) || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS trust, '<https://kg.example/id/nation/' || c_nationkey || '>' AS nation FROM customer WHERE c_custkey % 2 = 0")
def turtle_edge_metadata(spark, d):
    """Metadata of edges, written as Turtle with quoted triples and read back."""
    rows = kg(spark, d, "customer")
    edges = rows.filter((F.col("p") == t.ONT + "inNation") & (F.regexp_extract("s", r"(\d+)$", 1).cast("long") % 2 == 0))
    trust = (F.regexp_extract("s", r"(\d+)$", 1).cast("long") % 10).cast("string")
    folder = _folder(spark, "turtle-edges")
    turtle.write(edges.unionByName(E.annotate(edges, {t.ONT + "trust": trust})), folder)
    found = turtle.read(spark, folder)
    stated = found.filter((F.col("p") == t.REIFIES) & (F.col("o_kind") == "triple")).select("s", F.col("o_triple.s").alias("who"), F.col("o_triple.o_key").alias("nation"))
    said = found.filter(F.col("p") == t.ONT + "trust").select("s", F.col("o_key").alias("trust"))
    return stated.join(said, "s").select(F.regexp_extract("who", r"(\d+)$", 1).cast("long").alias("customer"), "trust", "nation")


@query(f"SELECT c_custkey AS customer, '\"' || c_name || '\"' AS name, c_acctbal AS balance, '<{NODE}nation/' || c_nationkey || '>' AS nation FROM customer")
def jsonld_compact(spark, d):
    """Compact node objects, as other programs write them, with prefixes and plain numbers."""
    people = table(spark, d, "customer")
    parts = parts_of(people, 50_000)
    rows = people.select(F.to_json(F.struct(
        F.concat(F.lit("id:customer/"), "c_custkey").alias("@id"), F.array(F.lit("ont:Customer")).alias("@type"), F.col("c_name").alias("rdfs:label"),
        F.col("c_acctbal").alias("ont:acctbal"), F.struct(F.concat(F.lit("id:nation/"), "c_nationkey").alias("@id")).alias("ont:inNation"),
    )).alias("value"))
    found = jsonld.parse(rows, parts=parts).repartition(parts, "s")
    one = lambda iri: F.max(F.when(F.col("p") == iri, F.col("o_key")))
    out = found.groupBy("s").agg(one(t.LABEL).alias("name"), one(t.ONT + "acctbal").alias("b"), one(t.ONT + "inNation").alias("nation"))
    return out.select(F.regexp_extract("s", r"(\d+)$", 1).cast("long").alias("customer"), "name", S.number(F.col("b")).alias("balance"), "nation")


# snapshots


@query(f"SELECT k FROM ({_LOG}) WHERE seq <= 800 GROUP BY k HAVING max_by(op, seq) = 'A'")
def snapshot_restore(spark, d):
    """The state after 800 changes, from the newest of three snapshots that is not after it."""
    folder, log = _folder(spark, "snapshots"), _log(spark, d)
    for seq in (300, 700, 900):
        snapshots.keep(snapshots.restore(log, ["k"], folder, seq), folder, seq)
    return snapshots.restore(log, ["k"], folder, 800)


@query(f"""WITH s AS (SELECT seq, row_number() OVER (ORDER BY seq DESC) <= 2 AS kept FROM (SELECT DISTINCT seq FROM ({_LOG}) WHERE seq IN (300, 700, 900)))
SELECT s.seq::BIGINT AS seq, s.kept, CASE WHEN s.kept THEN (SELECT count(DISTINCT k) FROM ({_LOG}) l WHERE l.seq <= s.seq) ELSE 0 END::BIGINT AS n FROM s""")
def snapshot_prune(spark, d):
    """Three kept sets of keys, of which the two newest stay: what is still there, and how much of it."""
    folder, log = _folder(spark, "snapshots"), _log(spark, d)
    numbers = [r["seq"] for r in log.filter(F.col("seq").isin(300, 700, 900)).select("seq").distinct().collect()]
    for seq in sorted(numbers):
        snapshots.keep(log.filter(F.col("seq") <= seq).select("k").distinct(), folder, seq)
    gone = snapshots.give_up(spark, folder, snapshots.surplus(snapshots.catalogue(spark, folder), 2))
    there = snapshots.catalogue(spark, folder).collect()
    out = [spark.read.parquet(f"{folder}/states/{r['name']}").agg(F.lit(r["seq"]).cast("long").alias("seq"), F.lit(True).alias("kept"), F.count("*").alias("n")) for r in there]
    return t.union(spark.createDataFrame([(seq, False, 0) for seq in gone], "seq long, kept boolean, n long"), *out)


# entities and terms


@query("SELECT 'Neuland' AS label, 'AMERICA' AS region, 26::BIGINT AS nations FROM region WHERE r_regionkey = 1")
def entity_create(spark, d):
    rows = kg(spark, d, "nation", "region")
    new = N.new_iri("Neuland", "nation")
    rows = N.create(rows, new, "Neuland", [t.ONT + "Nation"], values={t.ONT + "inRegion": f"<{node('region', 0)}>"}, lang="de")
    rows = N.patch(rows, new, add={t.ONT + "inRegion": f"<{node('region', 1)}>"}, remove={t.ONT + "inRegion": f"<{node('region', 0)}>"})
    own = F.col("s") == new
    return N.with_labels(rows, rows).agg(
        F.max(F.when(own & (F.col("p") == t.LABEL), F.col("o"))).alias("label"), F.max(F.when(own & (F.col("p") == t.ONT + "inRegion"), F.col("o_label"))).alias("region"),
        F.count(F.when((F.col("p") == t.TYPE) & (F.col("o") == t.ONT + "Nation"), 1)).alias("nations"),
    )


@query(f"SELECT '{NODE}nation/' || n_nationkey AS s, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def entity_labels(spark, d):
    rows = kg(spark, d, "nation", "region")
    own = rows.filter(F.col("p") == t.ONT + "inRegion")
    return N.with_labels(own, rows).select("s", F.col("o_label").alias("region"))


@query(f"""SELECT '{t.ONT}Nation' AS iri, 'Nation' AS label, (SELECT count(*) FROM nation) AS instances, (SELECT min('{NODE}nation/' || n_nationkey) FROM nation) AS example
UNION ALL SELECT '{t.ONT}Region', 'Region', (SELECT count(*) FROM region), (SELECT min('{NODE}region/' || r_regionkey) FROM region)
UNION ALL SELECT '{t.ONT}Port', 'Hafen', 0, NULL UNION ALL SELECT '{t.ONT}' || c, c, 0, NULL FROM (VALUES ('Customer'), ('Supplier'), ('Party'), ('locatedIn')) AS v(c)""")
def class_list(spark, d):
    rows = N.add_class(kg(spark, d, "nation", "region").unionByName(ontology(spark)), t.ONT + "Port", "Hafen", t.ONT + "Thing", lang="de")
    rows = N.add_property(rows, t.ONT + "portOf", "Hafen von", t.ONT + "Port", t.ONT + "Nation", lang="de")
    return N.class_list(rows).select("iri", "label", "instances", F.try_element_at("examples", F.lit(1)).alias("example"))


@query("SELECT (SELECT count(*) FROM nation) * 4 + (SELECT count(*) FROM region) * 3 + 14 AS quads, 2::BIGINT AS graphs, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS entities, (SELECT count(*) FROM nation) AS edges, 2::BIGINT AS classes, 3::BIGINT AS properties")
def graph_summary(spark, d):
    return N.summary(kg(spark, d, "nation", "region").unionByName(ontology(spark)))


@query(f"SELECT '{NODE}nation/' || n_nationkey AS s, CASE WHEN n_nationkey = 7 THEN 'corrected' ELSE 'first' END AS source FROM nation")
def metadata_replace(spark, d):
    rows = kg(spark, d, "nation")
    edges = rows.filter(F.col("p") == t.ONT + "inRegion")
    rows = rows.unionByName(E.annotate(edges, {t.ONT + "source": F.lit("first"), t.ONT + "confidence": F.lit("0.5")}))
    one = edges.filter(F.col("s") == node("nation", 7)).first()
    rows = N.replace_metadata(rows, one["s"], one["p"], one["o_key"], {t.ONT + "source": "corrected"})
    return E.annotations(rows, [t.ONT + "source"]).select("s", "source")


# dense vectors


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score
FROM embeddings WHERE vec_id <> 7 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 10""")
def embedding_topk(spark, d):
    """The ten vectors nearest to one by cosine."""
    rows = table(spark, d, "embeddings")
    asked = rows.filter("vec_id = 7").select("embedding").first()["embedding"]
    found = R.nearest(rows.filter("vec_id <> 7").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked)
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("SELECT label, place, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INTEGER - 1 AS place FROM embeddings) GROUP BY 1, 2")
def centroid_by_label(spark, d):
    """Whole centroids, one row for each component."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return rows.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("SELECT actor, count(*) AS undone, max(seq) AS last FROM (SELECT seq, actor, row_number() OVER (PARTITION BY actor ORDER BY seq DESC) AS r FROM (SELECT event_id AS seq, user_id::VARCHAR AS actor FROM events)) WHERE r <= 2 GROUP BY 1")
def undo_per_actor(spark, d):
    """Each actor takes the last two changes back: what is undone, in one window."""
    place = F.row_number().over(Window.partitionBy("actor").orderBy(F.desc("seq")))
    last = _log(spark, d).select("seq", "actor").distinct().withColumn("r", place).filter("r <= 2")
    return last.groupBy("actor").agg(F.count("*").alias("undone"), F.max("seq").alias("last"))


@query("""WITH l AS (SELECT event_id AS seq, user_id::VARCHAR AS actor, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
i AS (SELECT *, seq % 5 = 0 AND prev IS NOT NULL AND prev % 5 <> 0 AS undoes FROM l)
SELECT actor, count(*) FILTER (NOT undoes) - count(*) FILTER (undoes) AS undo, CASE WHEN max_by(undoes, seq) THEN 1 ELSE 0 END::BIGINT AS redo FROM i GROUP BY 1""")
def undo_redo_stacks(spark, d):
    """Heights of every actor's stacks, where each fifth change takes the one before it back."""
    prev = F.lag("seq").over(Window.partitionBy("actor").orderBy("seq"))
    log = _log(spark, d).select("seq", "actor").withColumn("prev", prev)
    log = log.withColumn("inverse_of", F.when((F.col("seq") % 5 == 0) & (F.col("prev") % 5 != 0), F.col("prev")))
    found = C.stacks_by(log, "actor")
    height = lambda name: F.count(F.when(F.col("stack") == name, 1)).alias(name)
    return log.select("actor").distinct().join(found, "actor", "left").groupBy("actor").agg(height("undo"), height("redo"))


@query("SELECT 'nations' AS name, (count(*) * 4)::BIGINT AS n FROM nation UNION ALL SELECT 'regions', (count(*) * 3)::BIGINT FROM region")
def vocabulary_load(spark, d):
    folder = _folder(spark, "vocabularies")
    turtle.write(kg(spark, d, "nation"), f"{folder}/nations.ttl")
    turtle.write(kg(spark, d, "region"), f"{folder}/regions.ttl")
    return vocabulary.loaded(vocabulary.load(spark, folder, ["nations", "regions"]))


@query(f"SELECT '{NODE}part/' || p_partkey AS iri, CASE WHEN p_partkey % 10 = 0 THEN 'renamed ' || p_partkey ELSE p_name END AS label FROM part WHERE p_partkey % 50 <> 0")
def search_upkeep(spark, d):
    """Records of all parts after some were renamed and others deleted, made anew for these only."""
    rows = kg(spark, d, "part")
    key = F.regexp_extract("s", r"(\d+)$", 1)
    label = (F.col("p") == t.LABEL) & (key.cast("long") % 10 == 0)
    after = rows.filter(key.cast("long") % 50 != 0).withColumn("o", F.when(label, F.concat(F.lit("renamed "), key)).otherwise(F.col("o")))
    touched = rows.filter(label).select("s").distinct()
    return R.refresh(R.records(rows), after, touched).select("iri", "label")


@query(f"SELECT '<{NODE}customer/' || c_custkey || '>' AS s, c_name || ' type Customer' AS first, 'Customer subClassOf Party' AS second FROM customer")
def explain_labels(spark, d):
    rows = kg(spark, d, "customer").unionByName(ontology(spark))
    done = I.materialise(I.facts_of(rows), "rdfs").derivations
    mine = done.filter((F.col("p") == f"<{t.TYPE}>") & (F.col("o") == p("Party")) & (F.col("rule") == "subclass-instance"))
    return I.explain_labelled(mine, rows).select("s", F.col("premises")[0].alias("first"), F.col("premises")[1].alias("second"))


@query("SELECT 'urn:kg:data' AS g, (SELECT count(*) FROM region) * 3 AS n UNION ALL SELECT 'urn:kg:copy', (SELECT count(*) FROM nation) * 4")
def graph_replace(spark, d):
    rows = kg(spark, d, "region")
    rows = E.replace_graph(rows, "urn:kg:copy", kg(spark, d, "supplier"))
    return A.counts(E.replace_graph(rows, "urn:kg:copy", kg(spark, d, "nation")))
