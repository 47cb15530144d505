"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A frequent-items sketch in the Misra-Gries family (``approx_top_k``) names the
digests that may be more frequent than its error bound, rows / (0.75 * max_items), of which there are at most
0.75 * max_items.  Their winners are found by an aggregate over
those digests alone, which combines map-side; these
are broadcast (some 6,000 rows of about 60 bytes, whatever the input) and the
losing copies go map-side.  All other digests take an ordinary shuffle, where no
group can be larger than that bound (unless a smaller ``k`` is asked for).

Defined cases: null text counts as empty; texts that differ only in A-Z/a-z are
equal; the largest doc_id stays, a null doc_id counting as the smallest; of rows
that repeat a doc_id and text, one stays; an empty table gives an empty result;
extra columns (also ones named like helpers) are ignored or passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, settle


def digest(text):
    return F.unhex(F.sha2(ascii_lower(text), 256))


def frequent_digests(digests: DataFrame, k: int | None = None, max_items: int = 8192) -> list[bytes]:
    """All digests that may be more frequent than rows / (0.75 * max_items), or the k most frequent: a bounded list."""
    tracked = 3 * max_items // 4
    row = digests.agg(F.expr(f"approx_top_k(hex(h), {k or tracked}, {max_items})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [bytes.fromhex(x["item"]) for x in row["top"] or [] if x["count"] > max(1, row["n"] // tracked)]


def verified_winners(digests: DataFrame, frequent: list[bytes]) -> DataFrame:
    """Exact size and winner of each frequent digest: h, win (doc_id, rid), n."""
    spark = digests.sparkSession
    names = spark.createDataFrame([(bytearray(h),) for h in frequent], "h binary")
    return (
        digests.join(F.broadcast(names), "h", "left_semi")
        .groupBy("h")
        .agg(F.max(F.struct("id", "rid")).alias("win"), F.count(F.lit(1)).alias("n"))
    )


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, max_items: int = 8192) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = settle(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("h")).withColumn("rid", F.monotonically_increasing_id()))
    frequent = frequent_digests(digests, k, max_items)
    light = digests
    heavy = None
    if frequent:
        winners = settle(verified_winners(digests, frequent))
        heavy = digests.join(F.broadcast(winners), "h")
        light = digests.join(F.broadcast(winners), "h", "left_anti")
    of = Window.partitionBy("h")
    light = light.withColumns({"win": F.max(F.struct("id", "rid")).over(of), "n": F.count(F.lit(1)).over(of)})
    every = light if heavy is None else light.unionByName(heavy)
    return every.select(
        F.col("id").alias("doc_id"),
        F.col("win.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rid") == F.col("win.rid")).alias("kept"),
        F.lower(F.hex("h")).alias("text_sha256"),
    )


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, max_items: int = 8192) -> DataFrame:
    """The documents that stay, whole rows with their own columns.

    The digests are settled first (40 bytes a row), so the frequent ones are known
    before any text moves; their losing copies are dropped map-side and only the rest is shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row).withColumns({"id": F.col("row")[id_col], "h": digest(F.col("row")[text_col])})
    digests = settle(keyed.select("id", "h").withColumn("rid", F.lit(0)))
    frequent = frequent_digests(digests, k, max_items)
    if frequent:
        winners = settle(verified_winners(digests, frequent).select("h", F.col("win.id").alias("keep")))
        keyed = keyed.join(F.broadcast(winners), "h", "left").filter(F.col("keep").isNull() | F.col("id").eqNullSafe(F.col("keep"))).drop("keep")
    first = Window.partitionBy("h").orderBy(F.col("id").desc_nulls_last())
    return keyed.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("row.*")
