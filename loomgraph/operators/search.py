"""Text and n-gram vector search over records (iri, label, comment, types, kind)."""

from __future__ import annotations

import hashlib
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import terms as t
from ..storage import Tables

K1, B = 1.2, 0.75
DIMENSIONS = 512


def records(rows: DataFrame) -> DataFrame:
    """One record for each subject of the data and ontology graphs, in one aggregation."""
    rows = rows.filter(F.col("g").isin(t.DATA, t.ONTOLOGY) & (F.col("s_kind") == "iri"))
    literal = F.col("o_kind") == "literal"
    label = F.min(F.when(F.col("p").isin(t.PREF_LABEL, t.LABEL) & literal, F.struct((F.col("p") == t.LABEL).alias("r"), "o")))
    comments = F.sort_array(F.collect_set(F.when((F.col("p") == t.COMMENT) & literal, F.col("o"))))
    types = F.sort_array(F.collect_set(F.when((F.col("p") == t.TYPE) & (F.col("o_kind") == "iri"), F.col("o"))))
    kind = F.when(F.max(F.col("g") == t.ONTOLOGY), "term").otherwise("entity")
    return rows.groupBy(F.col("s").alias("iri")).agg(
        F.coalesce(label.getField("o"), t.local_name(F.first("s"))).alias("label"), F.array_join(comments, " ").alias("comment"), types.alias("types"), kind.alias("kind")
    )


def refresh(old: DataFrame, rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Records after a change: those of the subjects in ``touched`` (s) are made anew from ``rows``, the graph after it."""
    fresh = records(rows.join(touched, "s", "left_semi").select(*rows.columns))
    return old.join(touched.withColumnRenamed("s", "iri"), "iri", "left_anti").select(*fresh.columns).unionByName(fresh)


def occurrences(text: Column, phrase: str) -> Column:
    """Overlapping occurrences of a phrase, both in lower case."""
    low, n = F.lower(text), len(phrase)
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1)))
    return F.size(F.filter(places, lambda i: F.substr(low, i, F.lit(n)) == phrase.lower()))


def select(recs: DataFrame, kind: str | None = None, cls: str | None = None) -> DataFrame:
    if kind is not None:
        recs = recs.filter(F.col("kind") == kind)
    return recs if cls is None else recs.filter(F.array_contains("types", cls))


def check_page(limit: int | None, offset: int) -> None:
    if min(limit or 0, offset) < 0:
        raise ValueError("limit and offset must not be negative")


def page(found: DataFrame, limit: int | None, offset: int, *order: str) -> DataFrame:
    """``limit`` rows from ``offset`` on; without either all rows, in no order."""
    if limit is None and not offset:
        return found
    rest = found.orderBy(*order).offset(offset)
    return rest if limit is None else rest.limit(limit)


def search(recs: DataFrame, query: str, kind: str | None = None, cls: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Records that hold the query in label or comment: iri, label, score.

    Queries of three letters and more are ranked by BM25 over letter trigrams
    (smaller is better), shorter and empty ones listed by iri.  Without a
    ``limit`` all are given, in no order, and no task holds them together.
    """
    check_page(limit, offset)
    text = F.concat_ws("\n", "label", "comment")
    query = query.strip()
    if len(query) < 3:
        found = select(recs, kind, cls).filter(F.lower(text).contains(query.lower())) if query else select(recs, kind, cls)
        return page(found.select("iri", "label", F.lit(0.0).alias("score")), limit, offset, "iri")
    grams = lambda c: F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0))
    hits = F.lower(text).contains(query.lower())
    counted = recs.withColumn("d", (grams("label") + grams("comment")).cast("double"))
    whole = counted.agg(F.count("*").alias("n"), F.avg("d").alias("avg"), F.count(F.when(hits, 1)).alias("df")).first()
    n, avg, df = whole["n"], whole["avg"] or 1.0, whole["df"]
    idf = math.log((n - df + 0.5) / (df + 0.5))
    idf = idf if idf > 0 else 1e-6
    freq = (occurrences(F.coalesce("label", F.lit("")), query) + occurrences(F.coalesce("comment", F.lit("")), query)).cast("double")
    score = -idf * freq * (K1 + 1) / (freq + K1 * (1 - B + B * F.col("d") / avg))
    found = select(counted, kind, cls).filter(hits).select("iri", "label", score.alias("score"))
    return page(found, limit, offset, "score", "iri")


def _normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """NFKC, casefold and single spaces, which Spark has no functions for."""
    return texts.map(_normal, na_action="ignore")


def ngrams(text: Column) -> Column:
    """All character 2-grams and 3-grams; a text shorter than n gives itself."""
    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(places, lambda i: F.substr(text, i, F.lit(n)))

    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.concat(of(2), of(3)))


@F.pandas_udf(T.IntegerType())
def bucket(grams: pd.Series) -> pd.Series:
    """Dimension of a gram; run on distinct grams only."""
    return grams.map(lambda g: int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") % DIMENSIONS)


def embed(texts: DataFrame) -> DataFrame:
    """(iri, dim, weight): unit vectors of hashed n-gram counts of (iri, text)."""
    clean = texts.select("iri", normalised("text").alias("clean"))
    grams = clean.select("iri", F.explode(ngrams(F.col("clean"))).alias("gram"))
    dims = grams.select("gram").distinct().withColumn("dim", bucket("gram"))
    counts = grams.groupBy("iri", "gram").count().join(dims, "gram").groupBy("iri", "dim").agg(F.sum("count").cast("double").alias("n"))
    length = counts.groupBy("iri").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    return counts.join(length, "iri").select("iri", "dim", (F.col("n") / F.col("len")).cast("float").alias("weight"))


def refresh_vectors(old: DataFrame, texts: DataFrame, touched: DataFrame) -> DataFrame:
    """Vectors after a change: those of ``touched`` (iri) are embedded anew from ``texts`` (iri, text), gone if they have none."""
    kept = old.join(touched, "iri", "left_anti").select("iri", "dim", "weight")
    return kept.unionByName(embed(texts.join(touched, "iri", "left_semi")))


def similar(vectors: DataFrame, query: DataFrame, limit: int = 10, least: float = 0.0) -> DataFrame:
    """(iri, score) of the vectors nearest to the query's (dim, weight), by cosine."""
    products = vectors.join(F.broadcast(query.select("dim", F.col("weight").alias("q"))), "dim")
    scores = products.groupBy("iri").agg(F.sum(F.col("weight").cast("double") * F.col("q")).alias("score"))
    return scores.filter(F.col("score") > least).orderBy(F.desc("score"), "iri").limit(limit)


def nearest(vectors: DataFrame, query: list[float], limit: int = 10, least: float = 0.0) -> DataFrame:
    """(id, score) of the dense vectors (id, vector) nearest to a query by cosine, ties by id.

    Only scores above ``least`` count.  The query is part of the plan, so no
    table is joined.  A zero query has no neighbour, nor has a vector that is
    null, zero, of another length or not finite.
    """
    length = math.sqrt(sum(x * x for x in query))
    e = F.col("vector").cast("array<double>")
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    sound = e.isNotNull() & (F.size(e) == len(query)) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(sound).select("id", dot(e, q).alias("dot"), F.sqrt(dot(e, e)).alias("own")).filter(F.col("own") > 0)
    if not length:
        rows = rows.limit(0)
    scored = rows.select("id", (F.col("dot") / (F.col("own") * F.lit(length or 1.0))).alias("score"))
    return scored.filter(F.col("score") > least).orderBy(F.desc("score"), "id").limit(limit)


def gram_cosine(texts: DataFrame) -> DataFrame:
    """(iri, gram, weight): unit vectors over the grams themselves."""
    counts = texts.select("iri", F.explode(ngrams(F.lower("text"))).alias("gram")).groupBy("iri", "gram").agg(F.count("*").cast("double").alias("n"))
    length = counts.groupBy("iri").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    return counts.join(length, "iri").select("iri", "gram", (F.col("n") / F.col("len")).alias("weight"))


def similar_pairs(weights: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of all pairs a < b of unit vectors (iri, gram, weight) with a cosine above ``least``.

    The grams of a vector are taken from the rarest on, until what is left of it
    is no longer than ``least``; two vectors that share none of these cannot
    reach it, so only such rare grams are joined, and the pairs verified.
    """
    tables = Tables(weights.sparkSession, "similar-pairs")
    weights = tables.cut(weights.select("iri", "gram", "weight"), "weights")
    counted = weights.join(weights.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    rest = Window.partitionBy("iri").orderBy("n", "gram").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rare = counted.withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(rest)).filter(F.col("rest") > least * least * (1 - 1e-9))
    rare = tables.cut(rare.select("iri", "gram"), "rare")
    a, b = rare.select(F.col("iri").alias("a"), "gram"), rare.select(F.col("iri").alias("b"), "gram")
    pairs = tables.cut(a.join(b, "gram").filter("a < b").select("a", "b").distinct(), "pairs")
    both = pairs.join(weights.select(F.col("iri").alias("a"), "gram", F.col("weight").alias("v")), "a")
    both = both.join(weights.select(F.col("iri").alias("b"), "gram", F.col("weight").alias("u")), ["b", "gram"])
    return both.groupBy("a", "b").agg(F.sum(F.col("v") * F.col("u")).alias("score")).filter(F.col("score") > least)
