"""The document tree as a table: nodes(nid, kind, number, title, page_start, page_end, body_text, preorder).

A node's nid is its path, so ancestors come from the key itself and subtree queries are equi-joins on an exploded
ancestor column rather than scans per node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def with_path(nodes: DataFrame) -> DataFrame:
    """Adds parent_nid, path and depth."""
    return nodes.withColumns({"parent_nid": T.parent_of(F.col("nid")), "path": F.split("nid", "/"), "depth": T.path_depth(F.col("nid"))})


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, nid) for every node and each of its ancestors, itself included."""
    return nodes.select(F.explode(T.ancestors_or_self(F.col("nid"))).alias("ancestor"), "nid")


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    return nodes.filter(T.within(F.col("nid"), F.lit(root)))


def tree_depth(nodes: DataFrame) -> DataFrame:
    """nid, depth_below: levels below each node (a leaf has 0)."""
    below = nodes.select(F.explode(T.ancestors_or_self(F.col("nid"))).alias("a"), T.path_depth(F.col("nid")).alias("d"))
    return below.groupBy(F.col("a").alias("nid")).agg((F.max("d") - F.min("d")).alias("depth_below"))


def descendant_counts(nodes: DataFrame) -> DataFrame:
    return closure(nodes).groupBy(F.col("ancestor").alias("nid")).agg((F.count(F.lit(1)) - 1).alias("descendants"))


def all_text(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """nid, all_text: bodies of the node and all below it, in reading order."""
    rows = nodes.select(F.explode(T.ancestors_or_self(F.col("nid"))).alias("a"), "preorder", F.coalesce("body_text", F.lit("")).alias("body"))
    if max_depth is not None:
        rows = rows.filter(T.path_depth(F.col("a")) <= max_depth)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("preorder", "body"))), lambda x: x["body"])
    return rows.groupBy(F.col("a").alias("nid")).agg(F.array_join(F.filter(ordered, lambda b: b != ""), "\n\n").alias("all_text"))


def find_by_number(nodes: DataFrame, numbers: DataFrame, kind: str | None = None) -> DataFrame:
    """number -> nid of the first node in reading order that bears it (of the kind, if given)."""
    rows = nodes.filter(F.col("kind") == kind) if kind else nodes
    return numbers.join(rows, "number", "left").groupBy("number").agg(F.min_by("nid", "preorder").alias("nid"))


def pages_owner(nodes: DataFrame) -> DataFrame:
    """page, nid: the last node in reading order whose page range holds the page."""
    pages = nodes.select("nid", "preorder", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return pages.groupBy("page").agg(F.max_by("nid", "preorder").alias("nid"))


def toc_ranges(toc: DataFrame) -> DataFrame:
    """toc(doc, seq, level, title, page) with page_end: the page before the next entry of the same or a higher level, at least its own page.

    One window a level, so a document costs levels x rows; the last entry runs to the end (null).
    """
    lowest, deepest = toc.agg(F.min("level"), F.max("level")).first()
    levels = list(range(lowest or 0, (deepest or 0) + 1))
    after = Window.partitionBy("doc").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.when(F.col("level") == k, F.first(F.when(F.col("level") <= k, F.col("page")), ignorenulls=True).over(after)) for k in levels]
    return toc.withColumn("page_end", F.greatest("page", F.coalesce(*nexts) - 1))


def counts_by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(T.path_depth(F.col("nid"))).alias("min_depth"), F.max(T.path_depth(F.col("nid"))).alias("max_depth"))


def outline(nodes: DataFrame, quotas: dict[int, int], default: int = 0) -> DataFrame:
    """nid, pos, sentence: the first sentences of each body, as many as its depth allows."""
    depth = T.path_depth(F.col("nid"))
    quota = F.coalesce(*[F.when(depth == d, F.lit(q)) for d, q in quotas.items()], F.lit(default))
    return nodes.select("nid", "preorder", F.posexplode(T.sentences(F.col("body_text"))).alias("pos", "sentence"), quota.alias("quota")).filter("pos < quota").select("nid", "preorder", "pos", "sentence")


def grouped_overview(nodes: DataFrame, kind: str, size: int = 4) -> DataFrame:
    """Titles of one kind in reading order, in groups of `size`: grp, first_nid, titles."""
    rows = nodes.filter(F.col("kind") == kind).withColumn("rn", F.row_number().over(Window.orderBy("preorder")) - 1)
    rows = rows.withColumn("grp", F.floor(F.col("rn") / size))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("preorder", "title"))), lambda x: x["title"])
    return rows.groupBy("grp").agg(F.min_by("nid", "preorder").alias("first_nid"), F.array_join(ordered, ", ").alias("titles"))


def best_template(templates: DataFrame, focus: Column) -> DataFrame:
    """Of each concept's templates the one nearest to the focus: longest shared path, then the first."""
    from ..functions.vectors import proximity

    w = Window.partitionBy("cid").orderBy(F.col("score").desc(), "seq")
    return templates.withColumn("score", proximity(F.col("home_nid"), focus)).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
