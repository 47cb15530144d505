"""Graphs, sidecars and results on disk.

A graph is five tables (vars, formulas, passages, concepts, edges) below one folder; each write makes a new version of the folder's tables and then points to it,
so a reader sees a whole graph, the old or the new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("vars", "formulas", "passages", "concepts", "edges")


def _points(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions that are whole, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(hadoop)) if files.exists(hadoop) else []


def write_graph(tables: dict[str, DataFrame], path: str) -> str:
    """Writes all tables as the graph's next version; the version counts once its marker is there."""
    spark = next(iter(tables.values())).sparkSession
    versions = _points(spark, path)
    name = f"v{int(versions[-1][1:]) + 1 if versions else 1:09d}"
    for table in TABLES:
        if table in tables:
            tables[table].write.mode("overwrite").parquet(f"{path}/{name}/{table}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{name}")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return name


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest whole version; none if there is none."""
    versions = _points(spark, path)
    found = {}
    for table in TABLES if versions else ():
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{versions[-1]}/{table}")
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            found[table] = spark.read.parquet(f"{path}/{versions[-1]}/{table}")
    return found


def read_levels(spark: SparkSession, path: str, key: str, levels: tuple[str, ...]) -> DataFrame:
    """A sidecar that maps keys to levelled texts ({key: {level: text}}): key, level, text of the levels that are filled."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, string>>").alias("m"))
    rows = raw.select(F.explode("m").alias(key, "texts")).select(key, F.explode("texts").alias("level", "text"))
    return rows.filter(F.col("level").isin(*levels) & (F.coalesce("text", F.lit("")) != ""))


def section_levels(spark: SparkSession, path: str) -> DataFrame:
    return read_levels(spark, path, "home_nid", ("L0", "L1", "L2", "L3", "L4"))


def formula_levels(spark: SparkSession, path: str) -> DataFrame:
    return read_levels(spark, path, "formula_id", ("F0", "F1", "F2"))


def read_equations(spark: SparkSession, path: str) -> DataFrame:
    """label, latex of an equations sidecar ({label: latex})."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("label", "latex"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """id and properties of a registry of books (JSON lines with an id)."""
    raw = spark.read.text(path).select(F.get_json_object("value", "$.id").alias("id"), F.from_json("value", "map<string, string>").alias("properties"))
    return raw.filter("id IS NOT NULL")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a row (triples, results, registries); fields in order of name, nulls left out."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("overwrite").text(path)
