"""The typed math graph: vars, formulas, passages, concepts and edges(seq, src, type, dst, weight, meta).

Upserts are aggregates over a log of additions ordered by `seq`, so a build is one pass and a rebuild gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The edge types of the graph, and those that count as anchors of a passage.
EDGE_TYPES = "uses binds defines references about paired_in_clause instance_of derived_from related_to specializes contains coreferent mentions".split()
ANCHOR_TYPES = "about paired_in_clause references mentions uses defines related_to instance_of".split()
#: Sizes of the pieces by which formulas that contain others are found; longer ones are in fewer formulas.
PIECES = (3, 6, 12, 24, 48)


def upsert_edges(log: DataFrame) -> DataFrame:
    """One row per (src, type, dst): weights add up, the latest meta stays, `seq` is the first. Unknown types raise."""
    known = F.col("type").isin(EDGE_TYPES)
    checked = log.withColumn("type", F.when(known, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown edge type: "), F.coalesce("type", F.lit("null"))))))
    return checked.groupBy("src", "type", "dst").agg(F.sum("weight").alias("weight"), F.max_by("meta", "seq").alias("meta"), F.min("seq").alias("seq"))


def merge_formulas(log: DataFrame) -> DataFrame:
    """One row per id: first latex and surface, cite labels united in order of arrival."""
    first = log.groupBy("id").agg(F.min_by("latex", "seq").alias("latex"), F.min_by("surface", "seq").alias("surface"), F.min_by("home_nid", "seq").alias("home_nid"), F.min("seq").alias("seq"))
    labels = log.select("id", "seq", F.posexplode("cite_labels").alias("pos", "label")).groupBy("id", "label").agg(F.min(F.struct("seq", "pos")).alias("at"))
    lists = labels.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("cite_labels"))
    return first.join(lists, "id", "left").withColumn("cite_labels", F.coalesce("cite_labels", F.array().cast("array<string>")))


def merge_vars(log: DataFrame) -> DataFrame:
    """One row per name: the first role other than scalar, else scalar."""
    role = F.coalesce(F.min_by("role", F.when(F.col("role") != "scalar", F.col("seq"))), F.lit("scalar"))
    return log.groupBy("name").agg(role.alias("role"), F.min("seq").alias("seq"))


def out_edges(edges: DataFrame, src: str, edge_type: str | None = None) -> DataFrame:
    rows = edges.filter(F.col("src") == src)
    return rows.filter(F.col("type") == edge_type) if edge_type else rows


def in_edges(edges: DataFrame, dst: str, edge_type: str | None = None) -> DataFrame:
    rows = edges.filter(F.col("dst") == dst)
    return rows.filter(F.col("type") == edge_type) if edge_type else rows


def formulas_using(edges: DataFrame, var: str) -> DataFrame:
    return in_edges(edges, var, "uses").select(F.col("src").alias("id")).distinct()


def shared_vars(edges: DataFrame) -> DataFrame:
    """a, b, n: variables that two formulas both use (a < b), by a self-join on the variable."""
    uses = edges.filter(F.col("type") == "uses").select("src", "dst").distinct()
    return uses.alias("x").join(uses.alias("y"), F.col("x.dst") == F.col("y.dst")).filter("x.src < y.src").groupBy(F.col("x.src").alias("a"), F.col("y.src").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def best_anchor(edges: DataFrame, formulas: DataFrame) -> DataFrame:
    """id, anchor, n: for each formula the other one that shares most variables; ties to the earlier one."""
    pairs = shared_vars(edges)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("anchor"), "n").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("anchor"), "n"))
    both = both.join(formulas.select(F.col("id").alias("anchor"), "seq"), "anchor")
    best = both.groupBy("id").agg(F.max(F.struct("n", (-F.col("seq")).alias("s"), "anchor")).alias("x"))
    return best.select("id", "x.anchor", "x.n")


def shared_labels(formulas: DataFrame) -> DataFrame:
    """src, dst, label: a formula and each earlier one with a cite label in common."""
    rows = formulas.select("id", "seq", F.explode(F.array_distinct("cite_labels")).alias("label"))
    return rows.alias("x").join(rows.alias("y"), "label").filter("x.seq > y.seq").select(F.col("x.id").alias("src"), F.col("y.id").alias("dst"), "label")


def paired_in_clause(passages: DataFrame) -> DataFrame:
    """passages(id, formula_ids): edges between the formulas of one passage, both ways."""
    rows = passages.select("id", F.posexplode(F.array_distinct("formula_ids")).alias("i", "a"), "formula_ids").select("a", F.explode(F.slice(F.array_distinct("formula_ids"), F.col("i") + 2, F.size("formula_ids"))).alias("b"))
    one = rows.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(one.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def containment_parents(formulas: DataFrame, rank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """id, parent: the longest earlier formula that strictly contains the id's latex (three characters at least).

    Copies of a key are contained alike, and of those that contain it the first is the earliest and wins: so distinct keys are joined, each with its first
    formula. A containing key holds every piece of the needle; the needle's rarest piece, of the largest of the sizes PIECES that fits it, is the join key.
    Of the containing keys of one length again the first wins, so a key keeps one of each length, among which each of its formulas takes the best that is
    earlier than itself. `rank` of (length, seq) is what the best has most of; it has to fall with seq within a length.
    """
    rank = rank or (lambda n, seq: F.struct(n.alias("n"), (-seq).alias("s")))
    rows = formulas.select("id", "seq", T.containment_key(F.col("latex")).alias("key")).filter(F.length("key") >= PIECES[0])
    keys = rows.groupBy("key").agg(F.max(F.struct((-F.col("seq")).alias("s"), "id")).alias("x")).select("key", F.length("key").alias("n"), (-F.col("x.s")).alias("pseq"), F.col("x.id").alias("parent"))

    def pieces(key: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(key) - size + 1), lambda i: F.substring(key, i, F.lit(size)))

    shorter = [F.when(F.col("n") > size, pieces(F.col("key"), size)).otherwise(F.array().cast("array<string>")) for size in PIECES]
    hay = keys.filter(F.col("n") > PIECES[0]).select("parent", "pseq", F.col("n").alias("pn"), F.col("key").alias("pkey"), F.explode(F.array_distinct(F.concat(*shorter))).alias("piece"))
    common = hay.groupBy("piece").agg(F.count(F.lit(1)).alias("c"))
    fits = F.coalesce(*[F.when(F.col("n") >= size, pieces(F.col("key"), size)) for size in reversed(PIECES)])
    needle = keys.select("key", "n", F.explode(F.array_distinct(fits)).alias("piece")).join(common, "piece", "left")
    needle = needle.groupBy("key", "n").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "piece"))["piece"].alias("piece"))
    hits = needle.join(hay, "piece").filter("pn > n AND contains(pkey, key)")
    firsts = hits.groupBy("key", "pn").agg(F.max(F.struct((-F.col("pseq")).alias("s"), "parent")).alias("x"))
    firsts = firsts.groupBy("key").agg(F.collect_list(F.struct("pn", (-F.col("x.s")).alias("pseq"), "x.parent")).alias("firsts"))
    earlier = F.filter("firsts", lambda x: x["pseq"] < F.col("seq"))
    best = F.array_max(F.transform(earlier, lambda x: F.struct(rank(x["pn"].cast("long"), x["pseq"]).alias("r"), x["parent"].alias("parent"))))
    found = rows.join(firsts, "key").select("id", best.alias("x")).filter("x IS NOT NULL")
    return found.groupBy("id").agg(F.max("x").alias("x")).select("id", "x.parent")


def coverage_report(passages: DataFrame, edges: DataFrame) -> DataFrame:
    """passages, with_formula (an `about` edge to a formula) and the share."""
    about = edges.filter((F.col("type") == "about") & ~F.startswith(F.col("dst"), F.lit("v:"))).select(F.col("src").alias("id")).distinct().withColumn("hit", F.lit(1))
    r = passages.join(about, "id", "left").agg(F.count(F.lit(1)).alias("passages"), F.count("hit").alias("with_formula"))
    return r.withColumn("coverage", F.when(F.col("passages") > 0, F.col("with_formula") / F.col("passages")).otherwise(0.0))


def anchor_density(passages: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """id, home_nid, anchors: edges of the anchor types at either end of each passage."""
    rows = edges.filter(F.col("type").isin(types or ANCHOR_TYPES))
    ends = rows.select(F.col("src").alias("id")).unionByName(rows.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("anchors"))
    return passages.join(ends, "id", "left").select("id", "home_nid", F.coalesce("anchors", F.lit(0)).alias("anchors"))


def anchor_coverage(density: DataFrame) -> DataFrame:
    """chapter, total, anchored, fraction."""
    chapter = F.regexp_extract("home_nid", r"^(b/ch[0-9]+)", 1)
    rows = density.withColumn("chapter", F.when(chapter == "", "other").otherwise(chapter))
    return rows.groupBy("chapter").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("anchors") > 0).alias("anchored")).withColumn("fraction", F.col("anchored") / F.col("total"))


def edge_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def canonical_by_cite(formulas: DataFrame) -> DataFrame:
    """cite, id: offline ids first, then the longest latex, then the first."""
    rows = formulas.select("id", "seq", "latex", F.explode("cite_labels").alias("cite")).withColumn("cite", T.citation_key(F.col("cite")))
    w = Window.partitionBy("cite").orderBy((~F.startswith("id", F.lit("f:"))).cast("int"), F.length("latex").desc(), "seq")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("cite", "id")


def nearest_lower_label(cites: DataFrame, formulas: DataFrame) -> DataFrame:
    """cites(cite_id, chapter, num), formulas(id, chapter, num): the formula of the chapter with the largest number not above (a backward as-of join)."""
    both = cites.select("chapter", "num", F.lit(1).alias("side"), "cite_id", F.lit(None).alias("id")).unionByName(formulas.select("chapter", "num", F.lit(0).alias("side"), F.lit(None).alias("cite_id"), "id"))
    upto = Window.partitionBy("chapter").orderBy("num", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("id", F.last("id", ignorenulls=True).over(upto)).filter("side = 1").select("cite_id", "id")
