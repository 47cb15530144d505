"""Lookups, upserts and picks over passages, formulas, concepts, topics and scenes.

All are equi-joins, aggregates or windows on the keys named; where several rows answer, the order that decides is part of the docstring.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prose
from ..functions import text as T
from .extraction import formula_variables, scan

# The kinds of blocks that are found by their first line.
BLOCKS = r"^[ \t]*(?P<a>Definition|Theorem|Lemma|Corollary|Proposition|Claim|Remark|Example|Exercise|Proof)\b\.?[ \t]*(?P<b>\d+(?:\.\d+)*)?"
BLOCK_CHARS = 1500
PROVABLE = ("theorem", "lemma", "corollary", "proposition", "claim")
SECTIONS = ("section", "subsection", "subsubsection")


def first_by(rows: DataFrame, keys: list[str], order: list[Column | str], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


# Nodes


def candidates(nodes: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Nodes with a text, of the kinds asked for."""
    rows = nodes.filter(F.coalesce(F.col("body_text"), F.lit("")).rlike(r"\S"))
    rows = rows.filter(F.col("kind").isin(include)) if include else rows
    return rows.filter(~F.col("kind").isin(exclude)) if exclude else rows


def by_number(nodes: DataFrame) -> DataFrame:
    """number, nid: the first section-like node with the number, else the first node of any kind."""
    return nodes.filter("trim(number) <> ''").groupBy(F.trim("number").alias("number")).agg(F.min(F.struct((~F.col("kind").isin(*SECTIONS)).alias("other"), "preorder", "nid"))["nid"].alias("nid"))


def environment(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests(kind, number) with the nid of the first such block."""
    known = nodes.groupBy("kind", "number").agg(F.min_by("nid", "preorder").alias("nid"))
    return requests.join(known, ["kind", "number"], "left")


def visible(nodes: DataFrame, skip_kinds: list[str], max_depth: int | None = None) -> DataFrame:
    """Nodes of a tree that no skipped node (or the depth) hides, with parent_nid: a skipped node hides what is under it."""
    depth = T.path_depth(F.col("nid"))
    parts = F.split("nid", "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hidden = nodes.select("nid", F.explode(paths).alias("up")).join(nodes.filter(F.col("kind").isin(skip_kinds)).select(F.col("nid").alias("up")), "up").select("nid").distinct()
    rows = nodes.join(hidden, "nid", "left_anti").withColumn("parent_nid", F.regexp_extract("nid", "^(.*)/[^/]+$", 1))
    return rows.filter(depth <= max_depth) if max_depth is not None else rows


def inherited(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """nid, value: a node's own value, else that of its nearest ancestor with one. values(nid, value)."""
    parts = F.split("nid", "/")
    ups = nodes.select("nid", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("d"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))).alias("x")).select("nid", "x.d", "x.up")
    got = ups.join(values.select(F.col("nid").alias("up"), "value"), "up").groupBy("nid").agg(F.max_by("value", "d").alias("value"))
    return nodes.select("nid").join(got, "nid", "left")


def lifted_edges(edges: DataFrame, depth: int = 2) -> DataFrame:
    """src, dst of edges between different ancestors at a depth (path segments), each once. edges(from_nid, to_nid)."""
    top = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, depth), "/")
    return edges.select(top("from_nid").alias("src"), top("to_nid").alias("dst")).filter("src <> dst").distinct()


def blocks(pages: DataFrame, id_col: str = "nid", text_col: str = "body_text") -> DataFrame:
    """id, start, kind, number, body, proof_of of blocks that a line opens (theorems, proofs, ...): the first of each (kind, number) of a text, up to the next one, 1500 characters at most;
    a proof belongs to the theorem-like block before it."""
    found = scan(pages, [BLOCKS], id_col, text_col, re.MULTILINE).select("id", "start", F.lower("a").alias("kind"), F.coalesce("b", F.lit("")).alias("number"))
    order = Window.partitionBy("id").orderBy("start")
    found = found.withColumn("end", F.lead("start").over(order))
    found = found.withColumn("proof_of", F.when(F.col("kind") == "proof", F.last(F.when(F.col("kind").isin(*PROVABLE), F.col("start")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    found = first_by(found, ["id", "kind", "number", F.when(F.col("number") == "", F.col("start")).otherwise(-1)], ["start"])
    texts = pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    body = F.substring(F.col("text"), F.col("start").cast("int") + 1, F.least(F.lit(BLOCK_CHARS), F.coalesce(F.col("end") - F.col("start"), F.lit(BLOCK_CHARS))).cast("int"))
    return found.join(texts, "id").select("id", "start", "kind", "number", body.alias("body"), "proof_of")


# Passages and formulas


def passage_key(text: Column) -> Column:
    return F.lower(T.squashed(F.regexp_replace(text, r"\s+", " ")))


def passages_by_text(clauses: DataFrame, passages: DataFrame) -> DataFrame:
    """clauses(cid, home_nid, text) with pid: the first passage of the home whose text is the same but for case and white space."""
    known = passages.withColumn("key", passage_key(F.col("text"))).filter("key <> '' AND home_nid <> ''").groupBy("home_nid", "key").agg(F.min_by("pid", "seq").alias("pid"))
    return clauses.withColumn("key", passage_key(F.col("text"))).join(known, ["home_nid", "key"], "left").select("cid", "pid")


def formulas_of_passages(edges: DataFrame, formulas: DataFrame) -> DataFrame:
    """pid, id: formulas that a passage is about."""
    about = edges.filter("type = 'about'").select(F.col("src").alias("pid"), F.col("dst").alias("id")).distinct()
    return about.join(formulas.select("id"), "id").select("pid", "id")


def formula_edges(formulas: DataFrame) -> DataFrame:
    """src, type, dst: uses, binds and defines edges to a formula's variables, references to its cite labels. formulas(id, latex, cite_labels)."""
    roles = formulas.select("id", formula_variables(F.col("latex")).alias("v"), "cite_labels")

    def edges(kind: str, names: Column, prefix: str) -> DataFrame:
        return roles.select(F.col("id").alias("src"), F.lit(kind).alias("type"), F.explode(names).alias("n")).select("src", "type", F.concat(F.lit(prefix), "n").alias("dst"))

    variables = [edges(kind, F.col(f"v.{part}"), "v:") for kind, part in (("uses", "used"), ("binds", "bound"), ("defines", "defined"))]
    cited = edges("references", F.transform("cite_labels", T.citation_key), "eq:")
    return variables[0].unionByName(variables[1]).unionByName(variables[2]).unionByName(cited).distinct()


def mentions_again(passages: DataFrame, formulas: DataFrame) -> DataFrame:
    """pid, id: formulas whose cite label (of the passage's own home, else anywhere) a passage's text names. passages(pid, home_nid, text), formulas(id, home_nid, cite, seq)."""
    named = scan(passages, [r"(?i)\b(?P<a>Equation|Eq\.?)\s*\(?(?P<b>\d+(?:\.\d+)*[a-z]?)"], "pid", "text").select(F.col("id").alias("pid"), F.col("b").alias("cite")).distinct()
    near = named.join(passages.select("pid", "home_nid"), "pid").join(formulas.withColumnRenamed("home_nid", "fhome"), "cite")
    return first_by(near, ["pid", "cite"], [(F.col("home_nid") != F.col("fhome")).cast("int"), "seq"]).select("pid", "id").distinct()


def explanations(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests(rid, formula_id, cite) with the key of their explanation: by formula, else the first by cite. known(eid, formula_id, cite, seq)."""
    by_id = known.groupBy("formula_id").agg(F.min_by("eid", "seq").alias("e1"))
    by_cite = known.filter("cite <> ''").groupBy("cite").agg(F.min_by("eid", "seq").alias("e2"))
    return requests.join(by_id, "formula_id", "left").join(by_cite, "cite", "left").select("rid", F.coalesce("e1", "e2").alias("eid"))


def label_index(formulas: DataFrame) -> DataFrame:
    """cite, id: the first formula with a latex for each label. formulas(id, seq, latex, cite)."""
    rows = formulas.withColumn("cite", prose.equation_key(F.col("cite"))).filter("cite <> '' AND trim(latex) <> ''")
    return rows.groupBy("cite").agg(F.min_by("id", "seq").alias("id"))


def canonical_formulas(formulas: DataFrame, uncited: int = 3) -> DataFrame:
    """home_nid, id: of a home's formulas one for each cite label and latex, then one for each label, and the first few without; offline ids first, then the longest latex, then the first."""
    best = [(~F.startswith("id", F.lit("n_offline_"))).cast("int"), F.length("latex").desc(), "seq"]
    once = first_by(formulas.withColumn("key", T.formula_key(F.col("latex"))), ["home_nid", "cite", "key"], best)
    cited = first_by(once.filter("cite <> ''"), ["home_nid", "cite"], best)
    return cited.unionByName(first_by(once.filter("cite = ''"), ["home_nid"], ["seq"], uncited)).select("home_nid", "id")


def recent_other(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds other: the last value before a row that differs from the row's own; one sorted pass a key."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    rows = rows.withColumn("__prev", before).withColumn("__other", F.when(F.col("__prev") != F.col(value), F.col("__prev")))
    return rows.withColumn("other", F.last("__other", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__prev", "__other")


def attributed(sentences: DataFrame, passages: DataFrame) -> DataFrame:
    """sentences(qid, pos, sentence), passages(qid, rank, did, text): the best-ranked passage that holds a sentence, else the query's top one."""
    top = passages.groupBy("qid").agg(F.min_by("did", "rank").alias("top"))
    hits = sentences.join(passages, "qid").filter(F.contains("text", F.col("sentence"))).groupBy("qid", "pos").agg(F.min_by("did", "rank").alias("did"))
    return sentences.select("qid", "pos").join(hits, ["qid", "pos"], "left").join(top, "qid", "left").select("qid", "pos", F.coalesce("did", "top").alias("did"))


def references_here(mentions: DataFrame, refs: DataFrame) -> DataFrame:
    """mentions(home_nid, label) with the target of the last cross reference of the home that has the label, or none."""
    last = refs.groupBy(F.col("from_nid").alias("home_nid"), "label").agg(F.max_by("to_nid", "seq").alias("to_nid"))
    return mentions.distinct().join(last, ["home_nid", "label"], "left")


# Concepts, topics, scenes


def concept_index(rows: DataFrame) -> DataFrame:
    """cid, aliases (distinct, in order of first mention), templates (in order). rows(cid, seq, alias, template)."""
    names = rows.groupBy("cid", "alias").agg(F.min("seq").alias("seq")).groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "alias"))), lambda x: x["alias"]).alias("aliases"))
    kept = rows.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "template"))), lambda x: x["template"]).alias("templates"))
    return names.join(kept, "cid")


def together(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Distinct pairs (a, b) of rows that share a key (figures and concepts of one home)."""
    return left.select(key, a).distinct().join(right.select(key, b).distinct(), key).select(a, b).distinct()


def canonical_concepts(surfaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """surfaces(surface) with cid: by the lower-cased form, else by its key. aliases(alias, cid)."""
    known = aliases.groupBy("alias").agg(F.min("cid").alias("cid"))
    rows = surfaces.withColumn("low", F.lower(F.trim("surface"))).withColumn("key", prose.concept_key(F.col("surface")))
    rows = rows.join(known.toDF("low", "c1"), "low", "left").join(known.toDF("key", "c2"), "key", "left")
    return rows.select("surface", F.coalesce("c1", "c2").alias("cid"))


def dominant_relation(edges: DataFrame, ruled: list[str]) -> DataFrame:
    """grp, relation: a group's relation that has a layout rule, then the most frequent, then the first by name. edges(grp, relation)."""
    counts = edges.groupBy("grp", "relation").agg(F.count(F.lit(1)).alias("n"))
    return first_by(counts, ["grp"], [(~F.col("relation").isin(ruled)).cast("int"), F.col("n").desc(), "relation"])


def container_parents(edges: DataFrame) -> DataFrame:
    """child, parent of the relations that nest (contains runs from the parent, the others from the child); the first parent stays. edges(src, dst, relation, seq)."""
    into = F.col("relation") == "contains"
    rows = edges.filter(F.col("relation").isin("part_of", "contains", "element_of", "subset_of"))
    rows = rows.select(F.when(into, F.col("dst")).otherwise(F.col("src")).alias("child"), F.when(into, F.col("src")).otherwise(F.col("dst")).alias("parent"), "seq").filter("child <> parent")
    return rows.groupBy("child").agg(F.min_by("parent", F.struct("seq", "parent")).alias("parent"))


def unique_topic(rows: DataFrame, text: Column, topics: dict[str, str]) -> DataFrame:
    """Adds topic: the only one of the topics (name: pattern) that a text matches, else null."""
    hits = F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in topics.items()])
    found = F.array_compact(hits)
    return rows.withColumn("topic", F.when(F.size(found) == 1, F.element_at(found, 1)))


def loose_topic(rows: DataFrame, query: Column, body: Column, topics: dict[str, str], preview: int = 1500) -> DataFrame:
    """Adds topic: the first that the query matches, else the first that the body's beginning (its feature: so many characters) matches twice."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, preview))
    return rows.withColumn("topic", F.coalesce(*[F.when(query.rlike(p), F.lit(t)) for t, p in topics.items()], *[F.when(F.regexp_count(head, F.lit(p)) >= 2, F.lit(t)) for t, p in topics.items()]))


def distinct_topics(rows: DataFrame, keys: list[str], order: str, topic: str) -> DataFrame:
    """Each topic of a session once, whatever its case, in its first spelling and with its first place."""
    w = rows.withColumn("__key", F.lower(topic)).groupBy(*keys, "__key").agg(F.min(F.struct(order, topic)).alias("x"))
    return w.select(*keys, f"x.{order}", f"x.{topic}")


def node_params(rows: DataFrame) -> DataFrame:
    """nid, params: a node's parameters, the last value of each key. rows(nid, key, value, seq)."""
    last = rows.groupBy("nid", "key").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("nid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("params"))


def edge_spans(rows: DataFrame) -> DataFrame:
    """id, spans: an edge once, with the distinct spans that it was found at."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def inverted(rows: DataFrame) -> DataFrame:
    """key, nids: artifacts by each of their keys, in lower case. rows(nid, keys)."""
    return rows.select("nid", F.explode("keys").alias("key")).filter("trim(key) <> ''").groupBy(F.lower(F.trim("key")).alias("key")).agg(F.array_sort(F.collect_set("nid")).alias("nids"))


def relevant(vectors: DataFrame, query: DataFrame, least: float = 0.30) -> DataFrame:
    """vectors(id, vec) near enough to the one query vector; all of them if there is none."""
    from ..functions.vectors import cosine

    rows = vectors.join(F.broadcast(query.select("qvec").limit(1)), how="left")  # one row at most
    return rows.filter(F.col("qvec").isNull() | (cosine(F.col("vec"), F.col("qvec")) >= least)).drop("qvec")
