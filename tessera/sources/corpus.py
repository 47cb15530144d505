"""Corpora on disk: versioned JSON documents, sidecars, text sources, registries and ledgers.

A document tree cannot be a recursive struct in Spark, so readers give flat node tables keyed by path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Newest version of the corpus JSON that can be read.
SCHEMA_VERSION = 1
NODE = "nid string, parent_nid string, kind string, number string, title string, page_start int, page_end int, body_text string, preorder bigint"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """nodes of every corpus JSON below a path (one document each): book_id, then the node's columns, preorder and parent. Newer versions raise."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("book_id"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            rows = []
            for book, value in zip(pdf["book_id"], pdf["value"], strict=True):
                doc = json.loads(value)
                if int(doc.get("schema_version", 1)) > SCHEMA_VERSION:
                    raise ValueError(f"{book}: corpus version {doc['schema_version']} is newer than {SCHEMA_VERSION}")
                stack, order = [(doc["root"], "")], 0
                while stack:
                    n, parent = stack.pop()
                    rows.append((book, n["nid"], parent, n.get("kind", ""), n.get("number"), n.get("title", ""), n.get("page_start"), n.get("page_end"), n.get("body_text", ""), order))
                    order += 1
                    stack += [(c, n["nid"]) for c in reversed(n.get("children", []))]
            yield pd.DataFrame(rows, columns=["book_id", "nid", "parent_nid", "kind", "number", "title", "page_start", "page_end", "body_text", "preorder"])

    return raw.mapInPandas(run, f"book_id string, {NODE}")


def nodes_as_json(nodes: DataFrame) -> DataFrame:
    """One JSON line a node with sorted fields, in reading order: equal tables give equal bytes."""
    return nodes.select("preorder", F.to_json(F.struct(*sorted(nodes.columns))).alias("value")).orderBy("preorder").select("value")


def write_lines(nodes: DataFrame, path: str) -> None:
    nodes_as_json(nodes).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).json(path)


def merge_sidecar(rows: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """Appends sidecar rows with a non-empty key that the table doesn't have; rows that repeat a key within the sidecar all come."""
    fresh = sidecar.filter(F.coalesce(F.col(key), F.lit("")) != "").join(rows.select(key).distinct(), key, "left_anti")
    return rows.unionByName(fresh, allowMissingColumns=True)


def read_texts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """path, text of .tex and .vtt files below a folder, stripped by kind, in order of path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tex,vtt}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    body = F.when(F.endswith("path", F.lit(".tex")), T.strip_latex(F.col("value"))).otherwise(T.strip_vtt(F.col("value")))
    return files.select("path", body.alias("text"))


def word_bounded_sentences(texts: DataFrame, low: int = 6, high: int = 40) -> DataFrame:
    """path, pos, sentence of sentences with low to high words."""
    rows = texts.select("path", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.filter(F.size(F.split("sentence", " ")).between(low, high))


def upsert(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Fields of the patch that are not null replace those of rows with the key; new keys are added."""
    old, new = table.alias("o"), patch.alias("n")
    columns = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    columns += [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in patch.columns else F.col(f"o.{c}") for c in table.columns if c != key]
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def unique_ids(rows: DataFrame, title: Column, order: list[str]) -> DataFrame:
    """Adds uid: the title's slug, with -2, -3 ... where it was taken before."""
    slug = F.regexp_replace(T.slug(title), "_", "-")
    w = Window.partitionBy("slug").orderBy(*order)
    rows = rows.withColumn("slug", F.when(slug == "", "book").otherwise(slug)).withColumn("k", F.row_number().over(w))
    return rows.withColumn("uid", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "k"))).drop("slug", "k")


def newest(sessions: DataFrame, limit: int) -> DataFrame:
    return sessions.orderBy(F.col("updated_at").desc(), "id").limit(limit)


def unexpired(sessions: DataFrame, now: Column, max_age_days: int) -> DataFrame:
    return sessions.filter(F.col("updated_at") >= now - F.make_interval(days=F.lit(max_age_days)))


def ledger(calls: DataFrame, cap: float) -> DataFrame:
    """Calls before the spending would pass the cap, with the sum so far. calls(ts, cost); the ledger has one order, so one sort."""
    w = Window.orderBy("ts", "cost").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("spent", F.sum("cost").over(w)).filter(F.col("spent") <= cap)


def snapshot_json(sessions: DataFrame) -> DataFrame:
    return sessions.select("id", F.to_json(F.struct(*[c for c in sorted(sessions.columns) if c != "id"])).alias("snapshot"))


def restore(snapshots: DataFrame, schema: str) -> DataFrame:
    """Snapshots back as columns; a corrupt one gives nulls."""
    return snapshots.select("id", F.from_json("snapshot", schema, {"mode": "PERMISSIVE"}).alias("s")).select("id", "s.*")


def loose_json(text: Column) -> Column:
    """The first JSON object in a text, as a variant; null without a valid one."""
    return F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
