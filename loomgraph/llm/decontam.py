"""Benchmark decontamination (operator 11) as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its stretches of ``width`` words (an item of fewer words
is one window).  A window is contained in a document only if all of its word
shingles are, so one necessary shingle is enough to find it:

1. the shingles of all windows are counted in all documents;
2. each window's shingles are ordered by rarity, and its rarest one is its prefix;
   a window with a shingle that no document has occurs nowhere and is dropped;
3. every shingle of a document is looked up among the prefixes, which gives a
   window and the place at which it would begin;
4. that place must leave room for the window on both sides (positional and
   length bounds), and its words must be those of the window, compared as text.

The item side is the one that is sent to the tasks, in blocks of at most
BROADCAST_ROWS rows and BLOCK_BYTES bytes of text; each block reads the documents
once.  Documents are never shuffled, only their hits are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._shared import Tables

WIDTH, SHINGLE = 10, 3
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case: what is between characters of ASCII that are neither letters nor digits."""
    plain = F.octet_length(text) == F.length(text)  # of ASCII alone, which ``lower`` takes at once
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, BREAKS), "")


def _keys(docs: DataFrame) -> DataFrame:
    """128 bits that name a doc_id with a text, so that rows with equal doc_ids but other texts stay apart."""
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(1), "doc_id", "text"))


def _hash(words: str | Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def _windows(items: DataFrame, width: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Tables of the distinct windows (wid, window, m) and of the items that have them (wid, item)."""
    ws = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text").cast("string")).alias("ws"))
    ws = ws.filter(F.size("ws") > 0).withColumn("m", F.least(F.size("ws"), F.lit(width)))
    at = F.sequence(F.lit(0), F.size("ws") - F.col("m"))
    uses = ws.select("item", "m", F.explode(F.transform(at, lambda i: F.array_join(F.slice("ws", i + 1, F.col("m")), " "))).alias("window"))
    uses = tables.cut(uses.distinct(), "uses")
    windows = tables.cut(uses.select("window", "m").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return windows, tables.cut(uses.join(windows.select("window", "wid"), "window").select("wid", "item"), "links")


def _blocks(table: DataFrame, key: str, texts: tuple[str, ...] = ()) -> list[DataFrame]:
    """The table in parts by a hash of ``key``, none above the bounds for what is sent to the tasks."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    rows, total = table.agg(F.count("*"), F.sum(size)).first()
    n = max(1, -(-rows // max(1, _shared.BROADCAST_ROWS)), -(-(total or 0) // BLOCK_BYTES))
    part = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(n))
    return [F.broadcast(table.filter(part == i) if n > 1 else table) for i in range(n)]


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """k1, k2, words, p and h: each document's shingles of the sizes asked for, by their place."""
    rows = _keys(docs).select("k1", "k2", words_of(F.col("text")).alias("ws"))
    rows = rows.select("k1", "k2", "ws", F.posexplode_outer("ws").alias("p", "w_"))
    if len(sizes) == 1:
        return rows.select("k1", "k2", "ws", "p", _hash("ws", F.col("p"), sizes[0]).alias("h"))
    return rows.select("k1", "k2", "ws", "p", F.explode(F.array(*[_hash("ws", F.col("p"), s) for s in sizes])).alias("h"))


def _prefixes(docs: DataFrame, windows: DataFrame, shingle: int, tables: Tables) -> tuple[DataFrame, list[int]]:
    """The rarest shingle of each window that may occur (h, off, m, wid, window), and the sizes of the shingles."""
    k = F.least("m", F.lit(shingle))
    sizes = [r[0] for r in windows.select(k.alias("k")).distinct().orderBy("k").collect()]  # at most ``shingle`` numbers
    ws = windows.select("wid", "m", F.split("window", " ").alias("ws"))
    parts = []
    for size in sizes:
        places = ws.filter(k == size).select("wid", "ws", F.explode(F.sequence(F.lit(0), F.col("m") - size)).alias("off"))
        parts.append(places.select("wid", _hash("ws", F.col("off"), size).alias("h"), "off"))
    if not parts:
        return tables.cut(windows.select(F.lit(0).cast("long").alias("h"), F.lit(0).alias("off"), "m", "wid", "window"), "prefixes"), [shingle]
    shingles = parts[0]
    for part in parts[1:]:
        shingles = shingles.union(part)
    shingles = tables.cut(shingles, "shingles")
    hashes = tables.cut(shingles.select("h").distinct(), "hashes")
    places = _positions(docs, sizes).select("h")
    counts = [places.join(block, "h").groupBy("h").agg(F.count("*").alias("n")) for block in _blocks(hashes, "h")]
    total = counts[0]
    for part in counts[1:]:
        total = total.union(part)
    counted = shingles.join(tables.cut(total, "counts"), "h", "left")
    rarest = counted.groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("s"))
    rarest = rarest.filter("s.n > 0").select("wid", "s.h", "s.off")
    return tables.cut(rarest.join(windows, "wid").select("h", "off", "m", "wid", "window"), "prefixes"), sizes


def _hits(docs: DataFrame, items: DataFrame, width: int, shingle: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Tables of the occurrences (k1, k2, start, m, wid) and of the items of each window (wid, item)."""
    windows, links = _windows(items, width, tables)
    prefixes, sizes = _prefixes(docs, windows, shingle, tables)
    start = F.col("p") - F.col("off")
    room = (start >= 0) & (start + F.col("m") <= F.size("ws"))
    same = F.array_join(F.slice("ws", start + 1, F.col("m")), " ") == F.col("window")
    found = None
    for block in _blocks(prefixes, "h", ("window",)):
        some = _positions(docs, sizes).join(block, "h").filter(F.when(room, same).otherwise(False)).select("k1", "k2", start.alias("start"), "m", "wid")
        found = some if found is None else found.union(some)
    return tables.cut(found, "hits"), links


def _with_items(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with wid joined with the items of their windows; the items are sent to the tasks in blocks."""
    out = None
    for block in _blocks(links, "wid", ("item",)):
        some = rows.join(block, "wid")
        out = some if out is None else out.union(some)
    return out


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def contained_windows(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, start (word number), n_words, window and item_id (as text): where windows of items occur.

    A window that several items share has a row for each.  Rows of ``docs``
    that agree in doc_id and text give the same rows, once.  Nulls are as in
    ``contamination``.
    """
    tables = Tables(docs.sparkSession, "decontam")
    docs = _plain(docs)
    hits, links = _hits(docs, items, width, shingle, tables)
    rows = _with_items(hits.distinct(), links)
    start, m = F.col("start"), F.col("m")
    ids = _keys(docs).select("doc_id", "k1", "k2", words_of(F.col("text")).alias("ws")).distinct()
    window = F.array_join(F.slice("ws", start + 1, m), " ")
    return rows.join(ids, ["k1", "k2"]).select("doc_id", start.cast("long").alias("start"), m.cast("long").alias("n_words"), window.alias("window"), F.col("item").alias("item_id"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    ``items`` has item_id and text.  n_hit counts the document's words inside of
    any window that occurs, n_items the different item_ids that have such a
    window, items_sha256 is of those ids as text, sorted, joined by commas (of
    no text if there are none).  Null and empty texts have no words and hit
    nothing, as documents and as items; an item without item_id hits words but
    is not counted among the items.  Repeated item_ids are one item with the
    windows of all its rows; repeated doc_ids are answered row by row.  Other
    columns are not read.  No items: nothing is hit; no documents: no row.
    """
    tables = Tables(docs.sparkSession, "decontam")
    docs = _plain(docs)
    hits, links = _hits(docs, items, width, shingle, tables)
    # what a document gathers is bounded by its own words; equal rows are merged before the shuffle
    spans = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("m")).alias("e"))
    per = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(spans)).alias("spans"), F.collect_set("wid").alias("wids"))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("e"))
    more = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["e"]))).alias("n"), F.greatest(acc["e"], x["e"]).alias("e")
    )
    per = tables.cut(per.select("k1", "k2", F.aggregate("spans", none, more)["n"].cast("long").alias("n_hit"), "wids"), "documents")
    named = _with_items(per.select("k1", "k2", F.explode("wids").alias("wid")), links)
    named = named.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = named.select("k1", "k2", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = tables.cut(per.select("k1", "k2", "n_hit").join(named, ["k1", "k2"]), "found")
    # a row has four numbers and 64 hexadecimal digits
    found = F.broadcast(found) if found.count() <= _shared.BROADCAST_ROWS else found
    n = F.coalesce(F.size(words_of(F.col("text"))), F.lit(0))
    rows = _keys(docs).select("doc_id", "k1", "k2", F.greatest(n, F.lit(0)).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return rows.join(found, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op11(spark, sf_dir: str) -> DataFrame:
    """All documents of the table against all items of the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
w AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[s : s + least(len(ws), 10) - 1], ' ') AS win
  FROM i, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) t(s) WHERE len(ws) > 0
),
p AS (
  SELECT rid, s, m, array_to_string(ws[s : s + m - 1], ' ') AS win
  FROM (SELECT rid, ws, unnest(ms) AS m FROM d, (SELECT list(DISTINCT m) AS ms FROM w)), unnest(range(1, len(ws) - m + 2)) t(s)
),
hit AS MATERIALIZED (SELECT rid, s, p.m, item_id FROM p JOIN w ON p.win = w.win AND p.m = w.m),
n AS (SELECT rid, count(DISTINCT place) AS n_hit FROM hit, unnest(range(s, s + m)) t(place) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
