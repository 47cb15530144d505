"""Data-quality checks: each gives one status row (check, status, value, threshold), so a report is a union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(df: DataFrame, name: str, value: Column, threshold: float, at_least: bool = True) -> DataFrame:
    row = df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))
    good = F.col("value") >= threshold if at_least else F.col("value") <= threshold
    return row.select(F.lit(name).alias("check"), F.when(good, "pass").otherwise("fail").alias("status"), "value", F.lit(float(threshold)).alias("threshold"))


def orphans(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key is nowhere in the known table."""
    return rows.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def no_orphans(name: str, rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return status(orphans(rows, key, known, known_key), name, F.count(F.lit(1)), 0, at_least=False)


def count_at_least(name: str, rows: DataFrame, n: int) -> DataFrame:
    return status(rows, name, F.count(F.lit(1)), n)


def share_at_least(name: str, rows: DataFrame, good: Column, share: float) -> DataFrame:
    return status(rows, name, F.avg(good.cast("double")), share)


def marker_coverage(name: str, markers: DataFrame, known: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """(occurrences - distinct markers without a match) / occurrences."""
    flagged = markers.join(known.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    missing = F.count_distinct(F.when(F.col("hit").isNull(), F.col(key)))
    return status(flagged, name, (F.count(F.lit(1)) - missing) / F.count(F.lit(1)), share)


def group_shares(rows: DataFrame, by: str, good: Column, share: float) -> DataFrame:
    """by, n, share, flagged: groups whose share of good rows is too low."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(good.cast("double")).alias("share")).withColumn("flagged", F.col("share") < share)


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
