"""Patches over sets of quads: apply, invert, undo, history, restore.

A log has a row for each change: seq, actor, ts, op (``A`` or ``D``), the quad's
key columns and, on inverses, inverse_of.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply(state: DataFrame, patch: DataFrame, key: list[str]) -> DataFrame:
    """``state`` after the deletions and then the additions of ``patch`` (op, key)."""
    gone = patch.filter("op = 'D'").select(*key)
    come = patch.filter("op = 'A'").select(*key)
    return state.select(*key).join(gone, key, "left_anti").unionByName(come).distinct()


def net(state: DataFrame, patch: DataFrame, key: list[str]) -> DataFrame:
    """The part of a patch that changes ``state``: additions of what is not there, deletions of what is."""
    add = patch.filter("op = 'A'").join(state.select(*key), key, "left_anti")
    return add.unionByName(patch.filter("op = 'D'").join(state.select(*key), key, "left_semi").select(*add.columns))


def invert(patch: DataFrame, seq: int) -> DataFrame:
    """The patch that takes ``patch`` back, numbered ``seq``."""
    return patch.withColumns({"inverse_of": F.col("seq"), "op": F.when(F.col("op") == "A", "D").otherwise("A"), "seq": F.lit(seq).cast("long")})


def stacks(headers: list[tuple[int, int | None]]) -> tuple[list[int], list[int]]:
    """Undo and redo stacks of a log's headers (seq, inverse_of), oldest first.

    Each change knows the one below it.  An inverse of the top of either stack
    takes that change's place away and goes on the other stack; any other change
    goes on the undo stack and ends what could be redone.
    """
    top: dict[str, int | None] = {"undo": None, "redo": None}
    below: dict[int, int | None] = {}
    for seq, inverse in headers:
        source = next((name for name in top if inverse is not None and top[name] == inverse), None)
        if source is None:
            below[seq], top = top["undo"], {"undo": seq, "redo": None}
        else:
            goal = "redo" if source == "undo" else "undo"
            top[source] = below[inverse]
            below[seq], top[goal] = top[goal], seq

    def from_top(seq: int | None) -> list[int]:
        out = []
        while seq is not None:
            out.append(seq)
            seq = below[seq]
        return out[::-1]

    return from_top(top["undo"]), from_top(top["redo"])


def stacks_by(headers: DataFrame, by: str) -> DataFrame:
    """(by, stack, place, seq): undo and redo stacks of each actor or project, the newest at place 0.

    ``headers`` has a row for each change: ``by``, seq and inverse_of.  One
    group's headers meet in a task, a few numbers for each of its changes.
    """

    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        inverse = [None if pd.isna(x) else int(x) for x in rows["inverse_of"]]
        undo, redo = stacks(list(zip(rows["seq"].tolist(), inverse, strict=True)))
        made = [(name, k, seq) for name, stack in (("undo", undo), ("redo", redo)) for k, seq in enumerate(reversed(stack))]
        out = pd.DataFrame(made, columns=["stack", "place", "seq"])
        out.insert(0, by, rows[by].iloc[0])
        return out

    kind = headers.schema[by].dataType.simpleString()
    rows = headers.select(by, "seq", F.col("inverse_of").cast("double").alias("inverse_of"))
    return rows.groupBy(by).applyInPandas(fn, f"`{by}` {kind}, stack string, place int, seq long")


def history(log: DataFrame, limit: int = 50) -> DataFrame:
    """Newest patches with their numbers of additions and deletions."""
    rows = log.groupBy("seq").agg(F.first("actor").alias("actor"), F.count(F.when(F.col("op") == "A", 1)).alias("additions"), F.count(F.when(F.col("op") == "D", 1)).alias("deletions"))
    return rows.orderBy(F.desc("seq")).limit(min(limit, 1000))


def between(log: DataFrame, after: int, upto: int) -> DataFrame:
    return log.filter((F.col("seq") > after) & (F.col("seq") <= upto))


def actors(log: DataFrame) -> DataFrame:
    return log.groupBy("actor").agg(F.countDistinct("seq").alias("patches"), F.count("*").alias("changes"))


def restore(log: DataFrame, key: list[str], seq: int, snapshot: DataFrame | None = None, snapshot_seq: int = 0) -> DataFrame:
    """The state at ``seq``: each key's last change decides, an addition within a
    patch after its deletion; keys that no later patch names come from the snapshot."""
    # without a snapshot every change counts, whatever number the log begins with
    tail = log.filter(F.col("seq") <= seq) if snapshot is None else between(log, snapshot_seq, seq)
    last = tail.groupBy(*key).agg(F.max(F.struct("seq", (F.col("op") == "A").alias("add"))).alias("last"))
    there = last.filter("last.add").select(*key)
    if snapshot is None:
        return there
    return there.unionByName(snapshot.select(*key).join(last, key, "left_anti")).distinct()


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """What turns one state into another, as rows (op, key)."""
    come = after.select(*key).distinct().join(before.select(*key), key, "left_anti").select(F.lit("A").alias("op"), *key)
    return come.unionByName(before.select(*key).distinct().join(after.select(*key), key, "left_anti").select(F.lit("D").alias("op"), *key))


def snapshot_due(ops: int, every: int = 200) -> bool:
    return ops > 0 and ops % every == 0


def serialise(log: DataFrame, statement: str = "statement") -> DataFrame:
    """Patch text: a header row before and a commit row after each patch's changes."""
    change = log.select("seq", F.lit(1).alias("part"), F.concat_ws(" ", "op", statement).alias("value"))
    heads = log.groupBy("seq").agg(F.first("actor").alias("actor"))
    head = heads.select("seq", F.lit(0).alias("part"), F.concat(F.lit("TX "), F.col("seq").cast("string"), F.lit(" "), "actor").alias("value"))
    tail = heads.select("seq", F.lit(2).alias("part"), F.lit("TC .").alias("value"))
    return head.union(change).union(tail)


def parse(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(seq, actor, op, statement) of patch text rows (file, line, value) in file order.

    A change belongs to the last header above it in its file.  With ``strict`` a
    line that is no header, change, commit or blank, a change without a header
    and a header before the commit of the last one are errors.
    """
    value = F.col("value")
    head, commit, change = value.startswith("TX "), value.rlike(r"^TC \.?$"), value.rlike("^[AD] ")
    seq = F.regexp_extract("value", r"^TX (\d+) ", 1).cast("long")
    actor = F.regexp_extract("value", r"^TX \d+ (.*)$", 1)
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(value.rlike(r"^TX \d+ "), F.struct(seq.alias("seq"), actor.alias("actor")))
    rows = lines.withColumn("h", F.last(header, ignorenulls=True).over(order))
    if strict:
        mark = F.when(head, "open").when(commit, "closed")
        before = F.last(mark, ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
        open_ = F.coalesce(before == "open", F.lit(False))
        wrong = F.when(~(head | commit | change | (F.trim("value") == "")), "no line of a patch").when(head & ~value.rlike(r"^TX \d+ "), "no number in the header")
        wrong = wrong.when(head & open_, "no commit before this header").when((change | commit) & ~open_, "no header above")
        said = F.concat(wrong, F.lit(" in "), F.col("file").cast("string"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), value)
        rows = rows.withColumn("value", F.when(wrong.isNotNull(), F.raise_error(said).cast("string")).otherwise(value))
    rows = rows.filter(F.col("value").rlike("^[AD] "))
    return rows.select("h.seq", "h.actor", F.substring("value", 1, 1).alias("op"), F.expr("substring(value, 3)").alias("statement"))
