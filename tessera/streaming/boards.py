"""Boards and turns of sessions: focus, chunks, ageing and eviction, over batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def focus(turns: DataFrame, session: str, order: str, topic: Column) -> DataFrame:
    """session, turns, focus: how many turns a session has and the last topic that one of them set."""
    return turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.max_by(topic, F.when(topic.isNotNull(), F.col(order))).alias("focus"))


def chunked(clauses: DataFrame, keys: list[str], text: Column, size: int) -> DataFrame:
    """keys, chunk, kind, part: a clause's chunks in order, then a row that completes it."""
    n = F.ceil(F.length(text) / size).cast("bigint")
    rows = clauses.select(*keys, text.alias("__text"), n.alias("__n")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n"))))
    part = F.when(F.col("chunk") < F.col("__n"), F.substring(F.col("__text"), (F.col("chunk") * size + 1).cast("int"), F.lit(size)))
    return rows.select(*keys, "chunk", F.when(F.col("chunk") == F.col("__n"), "complete").otherwise("chunk").alias("kind"), part.alias("part"))


def on_board(shapes: DataFrame, board: str, order: str, cap: int) -> DataFrame:
    """The shapes left on each board after all were added one by one, with fading.

    When a shape brings a board over its cap by e, its e + 1 oldest shapes are looked at: those that fade already go, and of the others e begin to fade.
    What is gone and what fades depends only on how many shapes came beyond the cap, and repeats with a short period, so a board is a
    row number and a count, not a sequence of states.
    """
    w = Window.partitionBy(board)
    rows = shapes.withColumn("__rn", F.row_number().over(w.orderBy(order))).withColumn("__over", F.count(F.lit(1)).over(w) - cap)
    m = F.greatest(F.col("__over"), F.lit(0))
    removed, marked = cycle(m)
    return rows.filter(F.col("__rn") > removed).withColumn("fading", F.col("__rn") <= removed + marked).drop("__rn", "__over")


def cycle(m: Column) -> tuple[Column, Column]:
    """How many shapes are gone and how many marked once m more than the cap were added (see on_board): by a table of the first steps, then a period."""
    first = [evictions(k) for k in range(8)]
    period = next(p for p in range(1, 5) if all(evictions(k + p)[0] - evictions(k)[0] == p and evictions(k + p)[1] == evictions(k)[1] for k in range(8, 24)))
    later = [evictions(8 + k) for k in range(period)]
    k = F.pmod(m - 8, F.lit(period))
    pick = lambda table, i, at: F.element_at(F.array(*[F.lit(x[i]) for x in table]), (at + 1).cast("int"))
    early = F.least(m, F.lit(7))
    gone = F.when(m < 8, pick(first, 0, early)).otherwise(pick(later, 0, k) + (m - 8 - k))
    return gone, F.when(m < 8, pick(first, 1, early)).otherwise(pick(later, 1, k))


def evictions(m: int) -> tuple[int, int]:
    """(gone, marked) after m shapes beyond the cap, step by step; ages fall from the oldest, so marks are always on the oldest shapes left."""
    gone = marked = 0
    for added in range(1, m + 1):
        excess = added - gone
        if excess <= 0:
            continue
        out = min(marked, excess + 1)
        fresh = min(excess, excess + 1 - out)
        gone, marked = gone + out, marked - out + fresh
    return gone, marked


def first_mentions(references: DataFrame, session: str, cite: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """A stream's (or table's) references, each cite once a session; a stream forgets a cite once the watermark has passed it."""
    if references.isStreaming:
        return references.withWatermark(at, late).dropDuplicatesWithinWatermark([session, cite])
    return references.dropDuplicates([session, cite])
