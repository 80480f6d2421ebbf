"""Periodic run detection (operator 13), after Kolpakov and Kucherov.

A run is a stretch of words with smallest period q, of at least MIN_LENGTH and
MIN_POWER * q words, that cannot be extended with that period.  For each text:

1. the words are cut into factors, each a word not seen before or the longest
   stretch that also begins further left (read from a suffix automaton);
2. Main's algorithm finds, at each end of a factor, the runs that cross or
   touch it, from longest common extensions to both sides of that place;
3. a run that lies strictly inside of a factor also lies in the factor's earlier
   occurrence, and is copied from there.

Every place of a run of power 4 holds a word that occurs at least four times in
that run.  Words that are rarer in their stretch therefore cut a text into
stretches, again and again; no run contains such a word, and the automaton is
built for the rest only.  Texts are answered row by row: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import crc32_text, slices

MIN_LENGTH, MIN_POWER = 6, 4
ROUNDS = 12  # of cutting at rare words, which only saves work
BLANKS = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, earlier begin or -1) of the factors of ``w``, in order."""
    moves: list[dict[int, int]] = [{}]
    link, depth, ends = [-1], [0], [-1]  # ends: where the first occurrence of a state's stretches ends
    last = 0
    for i, c in enumerate(w):
        new = len(moves)
        moves.append({}), depth.append(i + 1), ends.append(i), link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if depth[q] == depth[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(moves[q].copy()), depth.append(depth[p] + 1), ends.append(ends[q]), link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            then = moves[state][w[j]]
            if ends[then] >= j:
                break
            state, j = then, j + 1
        out.append((i, max(j, i + 1), ends[state] - (j - i) + 1 if j > i else -1))
        i = max(j, i + 1)
    return out


def extensions(x: list[int]) -> list[int]:
    """For each place of ``x`` how many items from there on agree with its beginning."""
    n = len(x)
    z = [0] * n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        if i + k >= hi:
            while i + k < n and x[k] == x[i + k]:
                k += 1
            lo, hi = i, i + k
        z[i] = k
    return z


def runs_at(w: list[int], begin: int, place: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs that cross or touch ``place`` and end by ``end``, where factors begin at ``begin`` and ``place``.

    A run whose last factor boundary is ``place`` begins less than twice the
    factor before it and once the factor after it further left.
    """
    after = end - place
    reach = min(place, 2 * (place - begin) + after)
    most = (reach + after) // MIN_POWER
    if most < 1 or reach + after < MIN_LENGTH:
        return
    left, right = w[place - reach : place], w[place : end + 1]
    back = left[::-1]
    past = extensions([*back, -1, *right[:after][::-1], *back])
    ahead = extensions([*right, -1, *left, *right])
    open_left = reach < place

    for q in range(1, min(most, after) + 1):  # a whole period to the right of the place
        s, e = past[reach + 1 + after - q], q + (ahead[q] if q < len(right) else 0)
        if s + e >= MIN_POWER * q and s + e >= MIN_LENGTH and e <= after and not (open_left and s >= reach):
            yield place - s, place + e, q
    for q in range(1, min(most, reach) + 1):  # and to the left
        s, e = q + (past[q] if q < reach else 0), ahead[len(right) + 1 + reach - q]
        if s + e >= MIN_POWER * q and s + e >= MIN_LENGTH and e <= after and not (open_left and s >= reach):
            yield place - s, place + e, q


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of ``w``, whose items are not negative."""
    parts = factors(w)
    found: dict[int, dict[int, int]] = {}
    for k, (begin, end, source) in enumerate([*parts, (len(w), len(w), -1)]):
        if k:
            for s, e, q in runs_at(w, parts[k - 1][0], begin, end):
                ends = found.setdefault(s, {})
                ends[e] = min(q, ends.get(e, q))
        if source >= 0 and found:
            shift = begin - source
            for s in range(source + 1, end - shift - MIN_LENGTH):
                for e, q in list(found.get(s, {}).items()):
                    if e + shift < end:
                        found.setdefault(s + shift, {})[e + shift] = q
    return sorted((s, e, q) for s, ends in found.items() for e, q in ends.items())


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Begins and ends of the stretches in which every word may lie in a run."""
    at = np.arange(len(ids))
    counts = np.bincount(ids)
    at = at[counts[ids] >= MIN_POWER]
    for _ in range(ROUNDS):
        if not len(at):
            return []
        part = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
        key = part * len(counts) + ids[at]
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        stay = (times[inverse] >= MIN_POWER) & (np.bincount(part)[part] >= MIN_LENGTH)
        if stay.all():
            break
        at = at[stay]
    edges = np.flatnonzero(np.diff(at) != 1) + 1
    begins, ends = at[np.concatenate([[0], edges])], at[np.concatenate([edges - 1, [len(at) - 1]])] + 1
    return [(b, e) for b, e in zip(begins.tolist(), ends.tolist(), strict=True) if e - b >= MIN_LENGTH]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start and period."""
    if len(words) < MIN_LENGTH:
        return []
    number = {x: k for k, x in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    out = []
    for begin, end in stretches(ids):
        out += [(begin + s, e - s, q) for s, e, q in runs(ids[begin:end].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([x for x, k in zip(words, np.cumsum(gone).tolist(), strict=False) if not k])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["start", "length", "period"]
    for batch in slices(batches, "text", 1 << 20):
        offsets, flat, counts, texts = [0], [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = (text or b"").split()  # at the blanks of ASCII: space and \x09 to \x0D
            found = runs_of(words)
            flat += found
            offsets.append(len(flat)), counts.append(len(words)), texts.append(collapsed(words, found))
        columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=names))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def word_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and the collapsed text of each row.

    Words are what blanks of ASCII divide; the collapsed text has one space
    between the words that are kept.  A null or empty text has no word, no run
    and an empty collapsed text.  Rows are answered one by one, so null or
    repeated doc_ids change nothing; other columns are not read, whatever their
    names, and an empty table gives no row.  A text's automaton takes some
    hundred bytes for each word of a stretch that may hold runs.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_describe, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents repeat a part of their words, as contract 13 asks.

    Which part, and with which period, follows from the crc32 of the doc_id; a
    document without doc_id or words stays as it is.
    """
    h = crc32_text(F.col("doc_id"))
    g, n = F.floor(h / 10), F.size("words_").cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = h % 10 == 0
    own = rows.filter(chosen).withColumn("words_", F.array_remove(F.split("text", BLANKS), ""))
    own = own.withColumn("a_", F.when(n > 0, g % n)).withColumn("p_", F.lit(1) + F.floor((n - F.col("a_")) / (F.lit(3) + g % 8)))
    word = lambda x, i: F.when(i < F.col("a_"), x).otherwise(F.get("words_", F.col("a_").cast("int") + ((i - F.col("a_")) % F.col("p_")).cast("int")))
    text = F.when(n > 0, F.array_join(F.transform("words_", word), " ")).otherwise(F.col("text"))
    return rows.filter(F.col("doc_id").isNull() | ~chosen).union(own.select("doc_id", text.alias("text")))


def op13(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = word_runs(planted(docs))
    empty = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    found = found.withColumn("best", F.aggregate("runs", empty, better))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
