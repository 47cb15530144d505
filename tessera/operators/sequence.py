"""Ordered operators: first-seen gates, caps, running times and consecutive suppression, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds first: whether the row is the first with its keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("first", F.row_number().over(w) == 1)


def dedup_report(rows: DataFrame, by: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """by, total, kept, dropped: first occurrences within each group."""
    r = first_seen(rows, [*by, *keys], order)
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("first").alias("kept"), F.count_if(~F.col("first")).alias("dropped"))


def capped(rows: DataFrame, by: list[str], order: list[str], caps: dict[str, int], kind: str) -> DataFrame:
    """At most caps[kind] rows of each kind within a group, in order; other kinds pass."""
    w = Window.partitionBy(*by, kind).orderBy(*order)
    cap = F.coalesce(*[F.when(F.col(kind) == k, F.lit(n)) for k, n in caps.items()], F.lit(2**31 - 1))
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap).drop("rn")


def capped_total(rows: DataFrame, amount: str, cap: float, order: list[str], by: list[str]) -> DataFrame:
    """Rows before the running sum would exceed the cap (a ledger with a hard limit)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(amount).over(w)).filter(F.col("running") <= cap)


def without_repeats(rows: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """Rows whose label differs from the last non-empty one before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col(label) != "", F.col(label)), ignorenulls=True).over(w)
    return rows.withColumn("before", before).filter((F.col(label) != F.col("before")) | F.col("before").isNull() | (F.col(label) == "")).drop("before")


def word_times(words: DataFrame, by: list[str], duration: Column) -> DataFrame:
    """words(..., pos, word): start and end of each word, time in proportion to its letters; the last ends with the clause."""
    w = Window.partitionBy(*by)
    run = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.greatest(F.length("word"), F.lit(1))
    rows = words.withColumn("total", F.sum(size).over(w)).withColumn("upto", F.sum(size).over(run)).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("pos")))
    end = F.when(F.col("i") == F.col("n"), duration).otherwise(duration * F.col("upto") / F.col("total"))
    return rows.withColumn("t_start", duration * (F.col("upto") - size) / F.col("total")).withColumn("t_end", end).drop("total", "upto", "n", "i")


def event_times(events: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """events(..., offset) at the start of the word that holds the offset, or of the next one; past the end, of the last."""
    spans = words.select(*by, F.col("w_start"), F.col("w_end"), F.col("t_start"))
    rows = events.join(spans, by, "left").filter("w_start IS NOT NULL")
    keys = [*by, "offset"]
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by("t_start", F.when(F.col("offset") < F.col("w_end"), F.col("w_start"))), F.max_by("t_start", "w_start")).alias("t"))


def islands(rows: DataFrame, by: list[str], at: str, gap: float) -> DataFrame:
    """Adds island: the number of the run of rows whose places are at most `gap` apart."""
    w = Window.partitionBy(*by).orderBy(at)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    return rows.withColumn("island", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def replayed(ops: DataFrame, until: float | None = None) -> DataFrame:
    """The board after an op log(t, seq, kind, nid, payload): of each nid the last add, move or update, unless a removal came after."""
    rows = ops.filter(F.col("t") <= until) if until is not None else ops
    last = rows.groupBy("nid").agg(F.max_by(F.struct("kind", "payload", "t"), F.struct("t", "seq")).alias("x"))
    return last.filter(F.col("x.kind") != "remove").select("nid", F.col("x.payload").alias("payload"), F.col("x.t").alias("t"))
