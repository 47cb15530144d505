"""Information extraction from text: aliases, dependencies, citations, definitions, variables.

Matches need offsets, which SQL's extract functions don't give, so scanners run in Arrow batches (one pass, rows out as they come) and all
counting, filtering and joining afterwards is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Shapes of concepts and acronyms, and the phrases that tie them.
CONCEPT = r"(?:[A-Za-z][A-Za-z0-9-]+(?:\s+[A-Za-z][A-Za-z0-9-]+){0,3})"
ACRONYM = r"(?:[A-Z][A-Z0-9]{1,5})"
ALIAS_RULES = [
    rf"\b(?:the\s+)?(?P<a>{CONCEPT})\s*\(\s*(?:also\s+(?:called|known\s+as)|or)\s+(?:the\s+)?(?P<b>{CONCEPT})\s*\)",
    rf"\b(?:the\s+)?(?P<a>{CONCEPT}),\s+(?:also\s+(?:called|known\s+as)|sometimes\s+called)\s+(?:the\s+)?(?P<b>{CONCEPT})\b",
    rf"\b(?:the\s+)?(?P<a>{CONCEPT}),\s+or\s+(?P<b>{ACRONYM})\b\s*[,)]",
    rf"\b(?:the\s+)?(?P<a>{CONCEPT})\s*\(\s*(?P<b>{ACRONYM})\s*\)",
]
# The phrases by which one concept (a) is said to rest on another (b); C stands for a concept.
DEPENDENCY_RULES = [
    r"\b(?:the\s+)?(?P<a>C)\s+(?:is|are)\s+built\s+(?:on|upon)\s+(?:the\s+)?(?P<b>C)\b",
    r"\b(?:the\s+)?(?P<a>C)\s+requires?\s+(?:the\s+|a\s+)?(?P<b>C)\b",
    r"\b(?:the\s+)?(?P<a>C)\s+uses?\s+(?:the\s+|a\s+)?(?P<b>C)\b",
    r"\b(?:the\s+)?(?P<a>C)\s+relies\s+on\s+(?:the\s+|a\s+)?(?P<b>C)\b",
    r"\b(?:the\s+)?(?P<a>C)\s+is\s+based\s+on\s+(?:the\s+|a\s+)?(?P<b>C)\b",
    r"\b(?:the\s+)?(?P<a>C)\s+generalizes?\s+(?:the\s+|a\s+)?(?P<b>C)\b",
    r"\b(?:the\s+)?(?P<a>C)\s+is\s+a\s+generali[sz]ation\s+of\s+(?:the\s+|a\s+)?(?P<b>C)\b",
    r"\b(?:the\s+)?(?P<a>C)\s+extends?\s+(?:the\s+|a\s+)?(?P<b>C)\b",
    r"to\s+understand\s+(?:the\s+)?(?P<a>C)\s*,\s+(?:we|you)?\s*(?:need|recall|review)\s+(?:the\s+|a\s+)?(?P<b>C)\b",
]
DEPENDENCY_RULES = [r.replace("<a>C", "<a>" + CONCEPT).replace("<b>C", "<b>" + CONCEPT) for r in DEPENDENCY_RULES]
CITATION = r"\b(?P<a>Theorem|Lemma|Proposition|Corollary|Definition|Example|Exercise|Equation|Eq\.|Section|Chapter|Figure|Fig\.|Table|Appendix|Remark|Claim)\s+(?P<b>\d+(?:\.\d+)*[a-zA-Z]?)"
# Words that are no concept, or start none.
NOISE = (
    "case section chapter figure table equation example exercise page appendix definition theorem lemma proof note remark see refer this that these those such each every "
    "the a an any all some many few fig eq ch thm way form kind type sort left right above below"
).split()
NO_START = (
    "we you he she it they i this that these those what which who and or but however thus hence therefore so yet while since because if when where as than though although "
    "here there now then next afterwards first second third finally lastly the a an any all some many few every each no such section chapter figure table equation example "
    "exercise page appendix definition theorem lemma proof note remark see refer case way form kind type sort in on at to from by with without for of into onto out up down "
    "off over under let consider suppose assume given set"
).split()


def scan(docs: DataFrame, rules: list[str], id_col: str, text_col: str, flags: int = 0) -> DataFrame:
    """id, rule, start, a, b of all matches of each rule."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(r, flags) for r in rules]
        for pdf in batches:
            rows = [(i, k, m.start(), m["a"], m["b"]) for i, t in zip(pdf["id"], pdf["text"], strict=True) if t for k, r in enumerate(compiled) for m in r.finditer(t)]
            yield pd.DataFrame(rows, columns=["id", "rule", "start", "a", "b"]).astype({"rule": "int32", "start": "int64"})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, rule int, start bigint, a string, b string")


def is_alias_phrase(s: Column) -> Column:
    words = F.split(F.lower(F.trim(s)), r"\s+")
    return F.length(F.trim(s)).between(2, 60) & ~F.element_at(words, 1).isin(NOISE) & F.exists(words, lambda w: ~w.isin(NOISE))


def is_dependency_phrase(s: Column) -> Column:
    words = F.split(F.lower(F.trim(s)), r"\s+")
    return F.length(F.trim(s)).between(3, 60) & ~F.element_at(words, 1).isin(NO_START) & F.exists(words, lambda w: (F.length(w) >= 3) & ~w.isin(NO_START))


def aliases(docs: DataFrame, id_col: str = "nid", text_col: str = "body_text", min_count: int = 1, limit: int | None = None) -> DataFrame:
    """alias, head, n: pairs by count, whichever way round they were written first; an alias keeps its first head."""
    hits = scan(docs, ALIAS_RULES, id_col, text_col).select("id", "rule", "start", T.phrase_key(F.col("a")).alias("head"), T.phrase_key(F.col("b")).alias("alias"), F.col("b").alias("raw"))
    hits = hits.filter(is_alias_phrase(F.col("head")) & is_alias_phrase(F.col("alias")) & (F.col("head") != F.col("alias")) & T.acronym_fits(F.col("head"), F.trim("raw")))
    hits = hits.filter(~F.contains(F.concat(F.lit(" "), F.col("head"), F.lit(" ")), F.concat(F.lit(" "), F.col("alias"), F.lit(" "))))
    order = F.struct("id", "rule", "start")
    pairs = hits.groupBy(F.least("head", "alias").alias("x"), F.greatest("head", "alias").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"), F.min_by(F.struct("head", "alias"), order).alias("p"))
    w = Window.partitionBy("alias").orderBy(F.col("n").desc(), "at")
    rows = pairs.filter(F.col("n") >= min_count).select("p.alias", "p.head", "n", "at").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return (rows.orderBy(F.col("n").desc(), "at").limit(limit) if limit else rows).drop("at")


def dependencies(docs: DataFrame, known: DataFrame, id_col: str = "nid", text_col: str = "body_text", min_count: int = 1) -> DataFrame:
    """head, prereq, n: both cut to the longest known term inside. known(term), in lower case.

    A phrase's word n-grams, up to the longest term's number of words, are an equi-join with the terms.
    """
    hits = scan(docs, DEPENDENCY_RULES, id_col, text_col).select("id", "rule", "start", T.phrase_key(F.col("a")).alias("a"), T.phrase_key(F.col("b")).alias("b"))
    hits = hits.filter(is_dependency_phrase(F.col("a")) & is_dependency_phrase(F.col("b")))
    for side, name in (("a", "head"), ("b", "prereq")):
        hits = best_known(hits, side, known, name)
    return hits.filter("head <> prereq").groupBy("head", "prereq").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def most_words(terms: DataFrame, term: str = "term") -> int:
    """Words of the longest term."""
    return terms.agg(F.max(F.size(F.split(term, " ")))).first()[0] or 1


def word_grams(phrase: Column, most: int) -> Column:
    words = F.split(phrase, " ")
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), n - i + 1)), lambda k: F.array_join(F.slice(words, i, k), " ")))
    return F.array_distinct(F.flatten(grams))


def best_known(rows: DataFrame, phrase: str, known: DataFrame, name: str) -> DataFrame:
    """Adds the longest known term in a phrase (ties alphabetical); rows without one go."""
    phrases = rows.select(phrase).distinct().select(phrase, F.explode(word_grams(F.col(phrase), most_words(known))).alias("term"))
    found = phrases.join(known.select("term").distinct(), "term").groupBy(phrase).agg(F.min(F.struct((-F.length("term")).alias("n"), "term"))["term"].alias(name))
    return rows.join(found, phrase)


def citations(docs: DataFrame, id_col: str = "nid", text_col: str = "body_text") -> DataFrame:
    """id, start, kind, number of every citation."""
    env = F.regexp_replace(F.lower("a"), r"\.$", "")
    kind = F.when(env == "fig", "figure").when(env == "eq", "equation").when(env == "thm", "theorem").otherwise(env)
    return scan(docs, [CITATION], id_col, text_col, re.IGNORECASE).select("id", "start", kind.alias("kind"), F.col("b").alias("number"))


def definition_term(body: Column) -> Column:
    """The term that a text begins by defining, else empty."""
    return F.trim(F.regexp_extract(F.substring(F.ltrim(body), 1, 240), r"^\s*(?:[Aa]n?|[Tt]he)\s+([A-Za-z][A-Za-z\- ]{2,40}?)\s+(?:is|are|denotes|means)\s+", 1))


def expand_queries(queries: DataFrame, alias_map: DataFrame) -> DataFrame:
    """queries(qid, query) with the heads of aliases they hold (and the aliases of heads) appended, those already there left out."""
    both = alias_map.select(F.col("alias").alias("term"), F.col("head").alias("more")).unionByName(alias_map.select(F.col("head").alias("term"), F.col("alias").alias("more")))
    grams = queries.select("qid", F.lower(T.squashed(F.col("query"))).alias("q")).select("qid", "q", F.explode(word_grams(F.regexp_replace("q", r"[^a-z0-9\- ]", ""), most_words(both))).alias("term"))
    extra = grams.join(both, "term").filter(~F.contains("q", F.col("more"))).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("more")), " ").alias("extra"))
    return queries.join(extra, "qid", "left").select("qid", F.concat_ws(" ", "query", "extra").alias("query"))


# Commands that are no variables, and letters that are.
NOT_VARIABLES = frozenset(
    (
        "frac sqrt left right begin end cdots ldots vdots ddots to rightarrow leftarrow Rightarrow Leftarrow iff implies sum prod int oint iint iiint lim max min sup inf argmax argmin "
        "in notin subset supset subseteq supseteq cup cap emptyset forall exists neg text mbox mathrm mathbf mathit mathcal mathbb mathfrak operatorname displaystyle textstyle "
        "hat tilde bar dot ddot vec overline underline quad qquad"
    ).lower().split()
)
GREEK = frozenset(
    (
        "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi omicron pi varpi rho varrho sigma varsigma tau upsilon phi varphi chi psi omega "
        "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega"
    ).split()
)
# Commands whose subscript binds variables, and signs that end the bound ones.
BINDERS = frozenset("sum prod int iint iiint oint lim max min sup inf forall exists argmax argmin".split())
RELATIONS = frozenset("=<>≤≥∈")
#: What a formula is read as: commands, words, Greek letters and single signs.
PART = re.compile(r"\\(?P<command>[A-Za-z]+)|(?P<word>[A-Za-z][A-Za-z0-9]*)|(?P<letter>[α-ωΑ-Ω])|(?P<sign>[^\s])")
#: One letter; two to four capitals; two or three small letters.
SYMBOL = re.compile("[^\\W\\d_]|[A-Z]{2,4}|[a-z]{2,3}")


def variable(raw: str) -> str:
    """A variable's name without backslash, indices and brackets; empty if it is none."""
    core = re.search(r"[^\s\\{}()\[\]_^]+|[_^]", raw)
    name = core[0] if core else ""
    if name.lower() in NOT_VARIABLES:
        return ""
    return name if name in GREEK or SYMBOL.fullmatch(name) else ""


class FormulaReader:
    """Reads a formula once, part by part, and notes the roles of its variables."""

    def __init__(self, latex: str):
        self.parts = [(m.lastgroup, m[m.lastgroup], m.end()) for m in PART.finditer(latex)]
        self.used = {v for kind, text, _ in self.parts if kind != "sign" and (v := variable(text))}
        self.bound = set(self._bound())
        self.defined = self._defined()

    def _sign(self, i: int, sign: str) -> bool:
        return i < len(self.parts) and self.parts[i][:2] == ("sign", sign)

    def _bound(self) -> Iterator[str]:
        for i, (kind, text, _) in enumerate(self.parts):
            if kind == "command" and text in BINDERS and self._sign(i + 1, "_") and self._sign(i + 2, "{"):
                inside = self.parts[i + 3 :]
                end = next((k for k, p in enumerate(inside) if p[0] == "sign" and p[1] in "{}"), None)
                if end is not None and inside[end][1] == "}":
                    yield from self._subscript(inside[:end])
            elif kind == "word" and text[0] == "d" and len(text) == 2 and text[1].isalpha():  # dy
                yield variable(text[1])
            elif kind == "word" and text == "d" and i + 1 < len(self.parts) and self.parts[i + 1][0] == "word" and len(self.parts[i + 1][1]) == 1:  # d y
                yield variable(self.parts[i + 1][1])

    @staticmethod
    def _subscript(parts: list) -> Iterator[str]:
        for kind, text, _ in parts:
            if kind == "sign" and text in RELATIONS:
                return
            if kind != "sign" and (v := variable(text)):
                yield v

    def _defined(self) -> str:
        """What stands left of the first equals sign: a function that is called, or the first variable."""
        left = next((self.parts[:i] for i, p in enumerate(self.parts) if p[:2] == ("sign", "=")), [])
        if left and left[0][0] in ("command", "word") and self._sign(1, "("):
            return variable(left[0][1])
        return next((v for kind, text, _ in left if kind != "sign" and (v := variable(text))), "")


def formula_roles(latex: str | None) -> tuple[list[str], list[str], list[str]]:
    """(used, bound, defined) variables of a formula, each sorted."""
    r = FormulaReader(latex or "")
    return sorted(r.used), sorted(r.bound - {""}), [r.defined] if r.defined else []


def formula_variables(latex: Column) -> Column:
    """struct<used, bound, defined> of variable names (an Arrow UDF: nested scans)."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(("used", "bound", "defined"), formula_roles(x), strict=True)) for x in s], columns=["used", "bound", "defined"])

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "used array<string>, bound array<string>, defined array<string>")(latex)
