"""Ranked retrieval: BM25, title boost, dense vectors and reciprocal-rank fusion.

Everything is an equi-join on terms: a query touches only the postings of its own terms, and document lengths travel with the postings, so
no query-by-document product is formed except for dense scores, whose query side is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settle
from ..functions import text as T
from ..functions import vectors as V

K1, B = 1.5, 0.75


#: Terms of queries that may be listed in the plan; with more, they are a join.
LISTED = 20_000


def tokenised(docs: DataFrame, terms: DataFrame, id_col: str = "nid", text_col: str = "body_text") -> DataFrame:
    """did, dl and ts, the tokens that are among the terms(term): each document is tokenised once, and what no query asks for is dropped before it is exploded."""
    listed = [r["term"] for r in terms.select("term").distinct().limit(LISTED + 1).collect()]
    ts = T.tokens(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("did"), ts.alias("ts")).select("did", F.size("ts").alias("dl"), "ts")
    if len(listed) <= LISTED:
        return settle(rows.select("did", "dl", F.filter("ts", lambda t: t.isin(listed)).alias("ts")))
    return rows


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """term, did, tf, dl of the terms."""
    rows = tokens.select("did", "dl", F.explode("ts").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "did").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n_docs (those without tokens count) and avgdl (at least 1)."""
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "nid", text_col: str = "body_text") -> DataFrame:
    """queries(qid, query) -> qid, did, bm25 of documents that share a term; a term that a query repeats counts as often."""
    terms = queries.select("qid", F.explode(T.content_tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qn"))
    tokens = tokenised(docs, terms, id_col, text_col)
    post = postings(tokens, terms)
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = post.join(df, "term").crossJoin(F.broadcast(corpus_stats(tokens)))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = idf * F.col("tf") * (K1 + 1) / F.greatest(F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")), F.lit(1e-9))
    return scored.select("term", "did", weight.alias("w")).join(terms, "term").groupBy("qid", "did").agg(F.sum(F.col("w") * F.col("qn")).alias("bm25"))


def ranked(scores: DataFrame, score: str, ties: list[str], k: int | None = None) -> DataFrame:
    """rank (from 0) of positive scores within a query, ties by the given columns."""
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), *ties)
    rows = scores.filter(F.col(score) > 0).withColumn("rank", F.row_number().over(w) - 1)
    return rows.filter(F.col("rank") < k) if k is not None else rows


def title_overlap(queries: DataFrame, titles: DataFrame, flavour: str = "answer") -> DataFrame:
    """qid, did, boost: 4 * shared + 8 * shared / title length.

    flavour "answer" divides by the title's tokens, stop words included; "benchmark" compares stop-filtered sets.
    """
    q = queries.select("qid", F.explode(F.array_distinct(T.content_tokens(F.col("query")))).alias("term"))
    t = titles.select("did", (T.tokens(F.col("title")) if flavour == "answer" else F.array_distinct(T.content_tokens(F.col("title")))).alias("ts"))
    t = t.select("did", F.size("ts").alias("tn"), F.explode(F.array_distinct("ts")).alias("term"))
    return q.join(t, "term").groupBy("qid", "did", "tn").agg(F.count(F.lit(1)).alias("shared")).select("qid", "did", (4.0 * F.col("shared") + 8.0 * F.col("shared") / F.col("tn")).alias("boost"))


def boosted(scores: DataFrame, boosts: DataFrame) -> DataFrame:
    """qid, did, score = bm25 + boost (either may be missing)."""
    return scores.join(boosts, ["qid", "did"], "full_outer").select("qid", "did", (F.coalesce("bm25", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"))


def dense(docs: DataFrame, queries: DataFrame, block: int = 2048) -> DataFrame:
    """docs(did, vec), queries(qid, qvec) -> qid, did, dense. The query side is dealt into blocks that each meet every document once."""
    n = queries.count()
    blocks = max(1, -(-n // block))
    q = queries.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    d = docs.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("b", F.col("b").cast("bigint"))
    return d.join(F.broadcast(q) if blocks == 1 else q, "b").select("qid", "did", V.cosine(F.col("vec"), F.col("qvec")).alias("dense"))


def fused(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """qid, did, rrf: the sum over rank lists of 1 / (k + rank), rank from 0."""
    rows = lists[0].select("qid", "did", "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("qid", "did", "rank"))
    return rows.groupBy("qid", "did").agg(F.sum(V.reciprocal_rank(F.col("rank"), k)).alias("rrf"))


def spliced(hits: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """Direct hits in front of a ranking, each document once, k rows a query: qid, did, place."""
    rows = hits.select("qid", "did", F.lit(0).alias("lane"), "rank").unionByName(ranking.select("qid", "did", F.lit(1).alias("lane"), "rank"))
    first = rows.groupBy("qid", "did").agg(F.min(F.struct("lane", "rank")).alias("at"))
    w = Window.partitionBy("qid").orderBy("at", "did")
    return first.withColumn("place", F.row_number().over(w) - 1).filter(F.col("place") < k).select("qid", "did", "place")


def low_similarity(passages: DataFrame, queries: DataFrame, dense_cut: float = 0.50, bm25_cut: float = 1.0) -> DataFrame:
    """qid, low: no passages, or best dense score under its cut, or (without dense scores) best BM25 under its own."""
    best = passages.groupBy("qid").agg(F.max("dense").alias("d"), F.max("bm25").alias("b"))
    low = F.when(F.col("d").isNull() & F.col("b").isNull(), True).when(F.col("d") > 0, F.col("d") < dense_cut).otherwise(F.coalesce(F.col("b") < bm25_cut, F.lit(True)))
    return queries.select("qid").join(best, "qid", "left").select("qid", low.alias("low"))


def answer_windows(passages: DataFrame, queries: DataFrame, width: int = 5) -> DataFrame:
    """passages(qid, did, body_text): of each query's passages the sentence with the highest BM25 (ties to the first), and those after it."""
    rows = passages.select("qid", "did", F.posexplode(T.sentences(F.col("body_text"))).alias("pos", "sentence")).filter(~T.is_caption(F.col("sentence")))
    q = queries.select("qid", F.explode(F.array_distinct(T.content_tokens(F.col("query")))).alias("term"))
    words = rows.select("qid", "did", "pos", F.explode(T.tokens(F.col("sentence"))).alias("term"))
    hits = words.join(q, ["qid", "term"]).groupBy("qid", "did", "pos").agg(F.count(F.lit(1)).alias("hits"))
    best = hits.groupBy("qid").agg(F.max(F.struct(F.col("hits"), (-F.col("did")).alias("nd"), (-F.col("pos")).alias("np"))).alias("x")).select("qid", (-F.col("x.nd")).alias("did"), (-F.col("x.np")).alias("anchor"))
    w = Window.partitionBy("qid").orderBy("pos")
    return rows.join(best, ["qid", "did"]).filter("pos >= anchor").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= width).select("qid", "did", "pos", "sentence")


def unique_title_queries(nodes: DataFrame, boilerplate: list[str] | None = None) -> DataFrame:
    """qid, query, gold_nid: titles that occur once and have two content tokens, not all boilerplate."""
    meaning = F.array_except(T.content_tokens(F.col("title")), F.array(*[F.lit(x) for x in boilerplate or ["introduction", "summary", "exercises", "notes"]]))
    w = Window.partitionBy(F.lower("title"))
    rows = nodes.withColumn("n", F.count(F.lit(1)).over(w)).filter((F.col("n") == 1) & (F.size(F.array_distinct(T.content_tokens(F.col("title")))) >= 2) & (F.size(meaning) > 0))
    return rows.select(F.col("nid").alias("qid"), F.col("title").alias("query"), F.col("nid").alias("gold_nid"))


def topic_pick(scores: DataFrame, least: float = 0.65, margin: float = 0.07) -> DataFrame:
    """qid, did: the best topic if good enough and clear of the second."""
    w = Window.partitionBy("qid").orderBy(F.col("dense").desc(), "did")
    rows = scores.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("dense").over(w))
    return rows.filter((F.col("rn") == 1) & (F.col("dense") >= least) & (F.col("dense") - F.coalesce("second", F.lit(-1.0)) >= margin)).select("qid", "did", "dense")


def answer_plan(fused: DataFrame, bm25_rows: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 3, width: int = 5) -> DataFrame:
    """qid, pos, did, sentence, low: the sentences that answer a query, each with the passage it comes from; low where all its passages are weak.

    fused(qid, did, rrf), bm25_rows(qid, did, bm25), docs(did, body_text), queries(qid, query).
    """
    top = ranked(fused, "rrf", ["did"], k).select("qid", "did", "rank")
    passages = top.join(docs, "did").join(bm25_rows, ["qid", "did"], "left").withColumn("dense", F.lit(0.0))
    said = answer_windows(passages.select("qid", "did", "body_text"), queries, width)
    return said.join(low_similarity(passages.select("qid", "dense", "bm25"), queries), "qid").select("qid", "pos", "did", "sentence", "low")
