"""Evaluation of rankers and classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_scores(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, rank (from 1), rr, hit1, hit5, hit10 of the gold document (no rank: all 0)."""
    rows = gold.join(ranking, ["qid", "did"], "left").select("qid", (F.col("rank") + 1).alias("rank"))
    hit = lambda k: F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)).alias(f"hit{k}")
    return rows.select("qid", "rank", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr"), hit(1), hit(5), hit(10))


def gold_ranks(scores: DataFrame, gold: DataFrame, score: str) -> DataFrame:
    """gold(qid, did) -> qid, rank (from 1) of the gold document among a query's positive scores, ties to the smaller did; null if it has none.

    Documents that beat the gold one are counted, so no query's ranking is sorted.
    """
    own = gold.join(scores.filter(F.col(score) > 0), ["qid", "did"]).select("qid", F.col("did").alias("gold"), F.col(score).alias("least"))
    better = scores.join(own, "qid").filter((F.col(score) > F.col("least")) | ((F.col(score) == F.col("least")) & (F.col("did") < F.col("gold"))))
    ranks = better.groupBy("qid").agg(F.count(F.lit(1)).alias("beaten"))
    ranks = own.join(ranks, "qid", "left").select("qid", (F.coalesce("beaten", F.lit(0)) + 1).alias("rank"))
    return gold.select("qid").join(ranks, "qid", "left")


def rank_scores(ranks: DataFrame) -> DataFrame:
    """qid, rank -> with rr, hit1, hit5, hit10 (no rank: all 0)."""
    hit = lambda k: F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)).alias(f"hit{k}")
    return ranks.select("qid", "rank", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr"), hit(1), hit(5), hit(10))


def ranking_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n"), F.avg("rr").alias("mrr"), *[F.avg(f"hit{k}").alias(f"recall{k}") for k in (1, 5, 10)])


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def per_class(rows: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of every label, from one pass over (gold, pred) counts."""
    cells = confusion(rows)
    parts = cells.select(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")).unionByName(
        cells.select(F.col("pred").alias("label"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("tp"))
    )
    s = parts.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("tp").alias("tp"))
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return s.select("label", "support", p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def macro(classes: DataFrame) -> DataFrame:
    """Macro precision and recall; macro F1 is their harmonic mean."""
    m = classes.agg(F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"))
    return m.withColumn("macro_f1", F.when(F.col("macro_p") + F.col("macro_r") > 0, 2 * F.col("macro_p") * F.col("macro_r") / (F.col("macro_p") + F.col("macro_r"))).otherwise(0.0))


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"))


def binary_report(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of boolean gold and pred."""
    g, p = F.col("gold"), F.col("pred")
    c = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumns({"f1": safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "accuracy": safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})


def balanced_sample(rows: DataFrame, label: str, order: list[Column], n: int) -> DataFrame:
    """n rows of each class, by a seeded order."""
    w = Window.partitionBy(label).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def index_percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, p50 at index n // 2 and p95 at index int(0.95 n) - 1 of the sorted values."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    r = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", n)
    at = lambda i, name: F.max(F.when(F.col("i") == i, F.col(value))).alias(name)
    return r.groupBy(*by).agg(F.first("n").alias("n"), F.avg(value).alias("mean"), at(F.floor(F.col("n") / 2), "p50"), at(F.greatest(F.floor(F.col("n") * 0.95) - 1, F.lit(0)), "p95"))


def profile(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Counts, mean and interpolated quantiles."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("max"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit rows: one big-integer step for each word of a."""
    where: dict[str, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | (1 << i)
    row = 0
    for w in a:
        x = where.get(w, 0) | row
        row = x & (x ^ (x - ((row << 1) | 1)))
    return row.bit_count()


def lcs_length(reference: Column, hypothesis: Column) -> Column:
    """Length of the longest common subsequence of two token arrays (an Arrow UDF: a recurrence)."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([_lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "bigint")(reference, hypothesis)


def rouge_l(pairs: DataFrame, beta: float = 1.2) -> DataFrame:
    """pairs(pair_id, reference, hypothesis: token arrays) with lcs and the ROUGE-L F score."""
    rows = pairs.withColumn("lcs", lcs_length(F.col("reference"), F.col("hypothesis")))
    r = F.col("lcs") / F.size("reference")
    p = F.col("lcs") / F.size("hypothesis")
    f = F.when((F.size("reference") == 0) | (F.size("hypothesis") == 0) | (F.col("lcs") == 0), 0.0).otherwise((1 + beta * beta) * p * r / (r + beta * beta * p))
    return rows.withColumn("rouge_l", f)
