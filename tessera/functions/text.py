"""Text functions of the retrieval, extraction and narration operators, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss"}
# Words that carry no weight in ranking.
STOP_WORDS = (
    "the and of to a an in on by for is are was were be as this that these those with from or if so but we it such any each all".split()
)
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = r"(?i)\b(?:e\.g|i\.e|cf|etc|Mr|Dr|St|Prof|Fig|Eq|Sec|Ch|Thm|Def)\.\s*$"
# The token and the sentence boundary.
TOKEN = r"[A-Za-z][A-Za-z\-]{1,}"
BOUNDARY = r"(?<=[.!?])\s+(?=[A-Z\(])"


def normalize_ligatures(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-case words of two letters or more."""
    return F.transform(F.regexp_extract_all(normalize_ligatures(text), F.lit(TOKEN), 0), lambda t: F.lower(t))


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))


def squashed(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences; one that ends in an abbreviation is joined to the next (in one pass over the parts)."""
    parts = F.filter(F.split(squashed(text), BOUNDARY), lambda s: s != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    step = lambda s, p: F.when(s["open"] == "", F.struct(s["done"].alias("done"), p.alias("open"))).when(
        s["open"].rlike(ABBREVIATIONS), F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit(" "), p).alias("open"))
    ).otherwise(F.struct(F.array_append(s["done"], s["open"]).alias("done"), p.alias("open")))
    return F.aggregate(parts, empty, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def chapter_of(nid: Column) -> Column:
    """The path up to its first chN segment, else empty."""
    return F.regexp_extract(nid, r"^((?:[^/]+/)*?ch[0-9]+)(?:/|$)", 1)


def second_segment(nid: Column) -> Column:
    """The first two path segments (the other notion of a chapter)."""
    return F.concat_ws("/", F.slice(F.split(nid, "/"), 1, 2))


def path_depth(nid: Column) -> Column:
    return F.size(F.split(nid, "/")) - 1


def parent_of(nid: Column) -> Column:
    return F.regexp_extract(nid, r"^(.*)/[^/]+$", 1)


def ancestors_or_self(nid: Column) -> Column:
    parts = F.split(nid, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))


def within(nid: Column, root: Column) -> Column:
    return (nid == root) | F.startswith(nid, F.concat(root, F.lit("/")))


def slug(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9]+", "_"), F.lit("_"))


def nid_segment(kind: Column, number: Column, title: Column) -> Column:
    """Path segment of a node: a short kind and its number, else its title's slug."""
    short = F.create_map(*[F.lit(x) for kv in {"chapter": "ch", "section": "s", "subsection": "ss", "theorem": "thm", "definition": "def", "example": "ex", "figure": "fig", "table": "tab"}.items() for x in kv])
    numbered = F.concat(F.coalesce(short[kind], kind), F.regexp_replace(number, r"\.", "_"))
    return F.when(F.coalesce(number, F.lit("")) != "", numbered).otherwise(F.concat_ws("_", F.coalesce(short[kind], kind), slug(title)))


def split_number(title: Column) -> Column:
    """(number, title) of a heading such as "5.8.1 Kernels"."""
    pattern = r"^\s*((?:[A-Z]|\d+)(?:\.\d+)*)\.?\s+(.+?)\s*$"
    hit = title.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(title, pattern, 1)).alias("number"), F.when(hit, F.regexp_extract(title, pattern, 2)).otherwise(F.trim(title)).alias("title")
    )


def citation_key(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?i)^\s*(?:Equation |Eq\. |Eq )", ""))


def spoken_citation(text: Column) -> Column:
    """Numbers of citations as they are read out: 5.8 -> 5 point 8."""
    return F.regexp_replace(text, r"(?i)\b(section|chapter|figure|table|equation|theorem)\s+(\d+)\.(\d+)", "$1 $2 point $3")


def formula_key(latex: Column) -> Column:
    return F.regexp_replace(F.coalesce(latex, F.lit("")), r"\s+", "")


def containment_key(latex: Column) -> Column:
    """Formula text without spacing commands, delimiters and blanks, in lower case."""
    bare = F.regexp_replace(F.coalesce(latex, F.lit("")), r"\\[\\,;:! ]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"\\\(|\\\)|\\\[|\\\]|\\left|\\right", ""), r"\s+", ""))


def phrase_key(text: Column) -> Column:
    """Lower case, one blank between words, no leading article."""
    return F.regexp_replace(squashed(F.lower(text)), r"^(?:the|a|an) ", "")


def strip_latex(text: Column) -> Column:
    """Prose of a .tex source: comments, commands and math taken out."""
    for pattern, to in ((r"(?m)(?<!\\)%.*$", ""), (r"(?s)\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)", " "), (r"\\begin\{[^}]*\}|\\end\{[^}]*\}", " "), (r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " "), (r"[{}~]", " ")):
        text = F.regexp_replace(text, pattern, to)
    return squashed(text)


def strip_vtt(text: Column) -> Column:
    """Speech of a .vtt source: header, cue times, cue numbers and tags taken out."""
    for pattern in (r"(?m)^WEBVTT.*$", r"(?m)^.*-->.*$", r"(?m)^\d+\s*$", r"<[^>]+>"):
        text = F.regexp_replace(text, pattern, " ")
    return squashed(text)


def clause_seconds(text: Column, cps: float = 15.0) -> Column:
    return F.greatest(F.lit(1.5), F.least(F.length(text) / cps, F.lit(30.0)))


def acronym_fits(head: Column, alias: Column) -> Column:
    """Whether an all-capital alias of 2 to 6 letters is made of the head's initials; other aliases pass."""
    words = F.filter(F.split(head, r"[\s-]+"), lambda w: w != "")
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    acronym = alias.rlike(r"[A-Z]") & (F.upper(alias) == alias) & F.length(alias).between(2, 6)
    return F.when((F.size(words) == 0) | (alias == ""), F.lit(False)).otherwise(~acronym | F.startswith(initials, alias))


def is_caption(sentence: Column) -> Column:
    """A figure or table caption, a numbered heading, or a short line mostly in capitals."""
    capitals = F.length(F.regexp_replace(sentence, r"[^A-Z]", "")) / F.greatest(F.length(F.regexp_replace(sentence, r"[^A-Za-z]", "")), F.lit(1))
    return sentence.rlike(r"^(?:FIGURE|Figure|Fig\.|TABLE|Table)\s+\d") | sentence.rlike(r"^\d+(?:\.\d+)*\s+[A-Z]") | ((capitals > 0.6) & (F.length(sentence) < 80))


def has_math_signal(text: Column) -> Column:
    return text.rlike(r"[=<>≤≥∑∫∏√]|\\[A-Za-z]+|\b[A-Za-z]\([A-Za-z]\)")


def is_truncated_latex(latex: Column) -> Column:
    """Unbalanced braces, or an operator or command at the end with nothing after it."""
    opened = F.length(F.regexp_replace(latex, r"[^{]", "")) != F.length(F.regexp_replace(latex, r"[^}]", ""))
    return opened | latex.rlike(r"(?:[=+\-*/^_]|\\(?:frac|sum|int|left|sqrt))\s*$")


def balanced_brackets(text: Column) -> Column:
    """Whether (), [] and {} close in order (a fold over the characters; "!" marks a failure)."""
    closes = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{")])
    chars = F.filter(F.split(text, ""), lambda c: c.isin(list("()[]{}")))
    step = lambda s, c: F.when(c.isin(list("([{")), F.concat(s, c)).when(F.endswith(s, closes[c]), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(F.lit("!"))
    return F.aggregate(chars, F.lit(""), step) == ""
