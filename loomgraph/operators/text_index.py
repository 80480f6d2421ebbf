"""A text index over records: positions of letter trigrams, kept in segments.

A posting says that a trigram begins at a place of a record's label or comment.
Postings lie in Parquet, divided by a hash of the trigram and ordered by it, so a
query opens the parts of its own trigrams.  A phrase occurs where all its
trigrams do, one after another; so occurrences are counted from the postings, and
no text is read.  An upkeep writes a segment with the records that changed and
the names of those whose earlier entries no longer count; segments are merged when
there are many.  Results are those of ``search.search`` over the same records.
"""

from __future__ import annotations

import math
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Manifest, joinable, size_on_disk
from . import search as scan

BUCKETS, MOST_SEGMENTS = 64, 8
_FIELDS = ("label", "comment")
_DOCS = "seq long, iri string, label string, comment string, types array<string>, kind string, d double"
_POSTINGS = "seq long, gram string, iri string, field int, place int, bucket int"
_GONE = "seq long, iri string"


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _name(seq: int) -> str:
    return f"segment-{seq}-{uuid.uuid4().hex[:12]}"


class TextIndex:
    """An index in ``folder``, which may be any folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifest = Manifest(spark, self.folder, "seq long, oldest long, name string")

    def segments(self) -> list[tuple[int, str]]:
        """Numbers and folders of the segments in force, oldest first; never more than MOST_SEGMENTS and one."""
        rows = self.manifest.read()
        oldest = rows.agg(F.max("oldest")).first()[0]
        return [] if oldest is None else sorted((r["seq"], r["name"]) for r in rows.filter(F.col("seq") >= oldest).collect())

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/{what}" for _, name in self.segments()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(path) for path in paths]  # each has partitions of its own
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (seq, iri) whose record has no later entry."""
        size = sum(size_on_disk(self.spark, f"{self.folder}/{name}/gone") for _, name in self.segments())
        gone = joinable(self._read("gone", _GONE).groupBy("iri").agg(F.max("seq").alias("later")), size)
        same = (rows["iri"] == gone["iri"]) & (rows["seq"] < gone["later"])
        return rows.join(gone, same, "left_anti")

    def records(self) -> DataFrame:
        """The records as they are now, with seq and d, their number of trigrams."""
        return self._alive(self._read("docs", _DOCS))

    def _part(self, name: str, what: str, seq: int, rows: DataFrame, schema: str) -> DataFrame:
        """Write a table of a segment and return it as read back, so that what it is made from is made once."""
        path = f"{self.folder}/{name}/{what}"
        rows.withColumn("seq", F.lit(seq).cast("long")).select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _write(self, seq: int, oldest: int, name: str, postings: DataFrame) -> None:
        """Write the postings of a segment whose other tables are there, and put it in force."""
        laid = postings.withColumn("seq", F.lit(seq).cast("long")).select(*[c.split()[0] for c in _POSTINGS.split(", ")])
        # a bucket with a very frequent trigram has several files
        laid = laid.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
        laid.write.partitionBy("bucket").parquet(f"{self.folder}/{name}/postings")
        self.manifest.add([(seq, oldest, name)])

    def build(self, recs: DataFrame) -> None:
        """Index all records (iri, label, comment, types, kind) anew."""
        seq = max([0, *(seq for seq, _ in self.segments())]) + 1
        name = _name(seq)
        self._part(name, "gone", seq, self.spark.createDataFrame([], "iri string"), _GONE)
        self._write(seq, seq, name, _postings(self._part(name, "docs", seq, _measured(recs), _DOCS)))

    def update(self, fresh: DataFrame, touched: DataFrame) -> None:
        """Records after a change: those in ``touched`` (iri) are taken from ``fresh``, and gone if they are not there."""
        there = self.segments()
        if not there:
            self.build(fresh)
            return
        seq = there[-1][0] + 1
        name = _name(seq)
        gone = self._part(name, "gone", seq, touched.select("iri").distinct(), _GONE)
        gone = joinable(gone.select("iri"), size_on_disk(self.spark, f"{self.folder}/{name}/gone"))
        own = fresh.join(gone, "iri", "left_semi").select(*fresh.columns)
        self._write(seq, there[0][0], name, _postings(self._part(name, "docs", seq, _measured(own), _DOCS)))
        if len(there) + 1 > MOST_SEGMENTS:
            self.merge()

    def merge(self) -> None:
        """One segment in place of all, from their postings and not from the texts."""
        seq = self.segments()[-1][0] + 1
        name = _name(seq)
        self._part(name, "gone", seq, self.spark.createDataFrame([], "iri string"), _GONE)
        self._part(name, "docs", seq, self.records(), _DOCS)
        self._write(seq, seq, name, self._alive(self._read("postings", _POSTINGS)))

    def occurrences(self, phrase: str) -> DataFrame:
        """seq, iri and how often a phrase of three letters or more, in lower case, occurs in the record."""
        grams: dict[str, list[int]] = {}
        for k in range(len(phrase) - 2):
            grams.setdefault(phrase[k : k + 3], []).append(k)
        own = F.col("gram").isin(list(grams)) & F.col("bucket").isin(sorted({_bucket(g) for g in grams}))
        offsets = F.try_element_at(F.create_map(*[x for g, ks in grams.items() for x in (F.lit(g), F.array(*map(F.lit, ks)))]), F.col("gram"))
        rows = self._read("postings", _POSTINGS).filter(own).select("seq", "iri", "field", "place", F.explode(offsets).alias("k"))
        starts = rows.groupBy("seq", "iri", "field", (F.col("place") - F.col("k")).alias("start")).agg(F.count("*").alias("n"))
        return self._alive(starts.filter(F.col("n") == len(phrase) - 2).groupBy("seq", "iri").agg(F.count("*").cast("double").alias("freq")))

    def search(self, query: str, kind: str | None = None, cls: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
        """As ``search.search`` over the records; texts are read only for queries of less than three letters."""
        scan.check_page(limit, offset)
        phrase, docs = query.strip().lower(), self.records()
        if len(query.strip()) < 3 or len(phrase) < 3 or "\n" in phrase:  # the last may run from the label into the comment
            return scan.search(docs, query, kind, cls, limit, offset)
        hits = self.occurrences(phrase)
        whole = docs.agg(F.count("*").alias("n"), F.avg("d").alias("avg")).first()
        n, avg, df = whole["n"], whole["avg"] or 1.0, hits.count()
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 0.0) or 1e-6
        freq = F.col("freq")
        score = -idf * freq * (scan.K1 + 1) / (freq + scan.K1 * (1 - scan.B + scan.B * F.col("d") / avg))
        found = scan.select(docs, kind, cls).join(hits, ["seq", "iri"]).select("iri", "label", score.alias("score"))
        return scan.page(found, limit, offset, "score", "iri")


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _measured(recs: DataFrame) -> DataFrame:
    """Records and their number of trigrams."""
    grams = lambda c: F.greatest(F.length(_plain(c)) - 2, F.lit(0))
    return recs.select("iri", "label", "comment", "types", "kind", (grams("label") + grams("comment")).cast("double").alias("d"))


def _postings(docs: DataFrame) -> DataFrame:
    """The postings of documents."""
    def of(number: int, name: str) -> DataFrame:
        low = docs.select("iri", F.lower(_plain(name)).alias("low")).filter(F.length("low") >= 3)
        return low.select("iri", F.lit(number).alias("field"), "low", F.explode(F.sequence(F.lit(1), F.length("low") - 2)).alias("place"))

    places = of(0, _FIELDS[0]).unionByName(of(1, _FIELDS[1]))
    gram: Column = F.substr("low", F.col("place"), F.lit(3))
    return places.select("iri", "field", "place", gram.alias("gram")).withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int"))
