"""Intent routing as one CASE over ordered rules, so an utterance table is classified in a single projection.

Rules (the first that holds): control, recap, cross-reference, dependencies, reshow, book, chapter (unless a section is named), section (if it
resolves), follow-up, question. Depth is independent of the intent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases of each rule.
CONTROL = {
    "pause": r"\bpause\b",
    "resume": r"\b(?:resume|un\s*pause|continue\s+reading)\b",
    "stop": r"\b(?:stop|cancel|that's enough|enough)\b",
    "skip": r"\bskip(?:\s+ahead)?\b",
    "louder": r"\b(?:louder|speak\s+up)\b",
    "quieter": r"\b(?:quieter|softer)\b",
    "slow": r"\b(?:slow(?:er)?\s+down|slow(?:er)?)\b",
    "fast": r"\b(?:speed\s+up|faster)\b",
    "forget": r"\b(?:forget(?:\s+(?:that|what\s+we\s+(?:covered|said)|everything))?|start\s+fresh|reset(?:\s+(?:memory|context))?|clear\s+(?:what\s+we\s+covered|memory|context))\b",
}
RECAP = r"\b(?:what\s+(?:have\s+we|did\s+(?:you|we))\s+(?:cover(?:ed)?|discuss(?:ed)?|gone\s+over)|recap(?:\s+(?:what|this|so\s+far))?|(?:summari[sz]e|summary\s+of)\s+(?:what\s+we|our|this\s+session|so\s+far)|where\s+are\s+we\s+(?:so\s+far|now))\b"
XREF = r"\b(?:see\s+also|what\s+else\s+(?:references?\s+this|cites?\s+this|uses?\s+this)|related\s+(?:section|chapter|content|material)s?|where\s+(?:else\s+)?is\s+this\s+(?:used|cited|referenced)|citation(?:s)?\s+(?:graph|neighbor(?:hood)?|context)|cross[\s-]?references?)\b"
DEPENDS = r"\b(?:prerequisite(?:s)?|what\s+(?:do\s+i|should\s+i)\s+(?:need\s+to\s+)?know\s+(?:first|before)|what\s+(?:does\s+this|do\s+i)\s+need\s+to\s+understand|background\s+(?:for|on)\s+\S+|what\s+(?:does\s+this\s+depend\s+on|depends?\s+on)|before\s+(?:i|we)\s+(?:learn|study|read)|what\s+comes\s+before)\b"
RESHOW = r"\b(?:(?:show\s+me|explain|tell\s+me\s+about)\s+.{1,80}?\s+again\b|repeat(?:\s+that|\s+it)?|(?:once|one)\s+more(?:\s+time)?|say\s+that\s+again)\b"
AGAIN = r"^\s*again\s*[!?.]?\s*$"
BOOK = r"\b(?:(?:what(?:'?s| is)|tell me).{0,15}\bthis\s+book\b|(?:summari[sz]e|overview\s+of)\s+(?:the\s+)?book|book\s+(?:overview|summary)|what\s+is\s+the\s+book\s+about)\b"
CHAPTER = r"\bchapter\s+(\d+)\b"
SECTION = r"\bsection\s+(\d+(?:\.\d+){0,2})\b|\b§\s*(\d+(?:\.\d+){0,2})\b|(?<![\w.])(\d+\.\d+(?:\.\d+)?)(?![\w.])"
FOLLOW_UP = r"\b(?:tell me more|more about (?:that|this|it)|go deeper|deeper|elaborat(?:e|ing)|explain (?:that|this|it|more)|continue|carry on|keep going|go on|(?:say|tell)\s+more)\b"
SOLO = ("more", "deeper", "continue", "elaborate", "go on", "carry on", "keep going")
SHORT = r"\b(?:short(?:ly)?|brief(?:ly)?|in\s+a\s+(?:sentence|line)|tl;?dr)\b"
DEEP = r"\b(?:deep(?:ly|er)?|in\s+detail|thorough(?:ly)?|step\s+by\s+step|long(?:er)?)\b"


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def action(text: Column) -> Column:
    return F.coalesce(*[F.when(_has(text, p), F.lit(name)) for name, p in CONTROL.items()])


def section_number(text: Column) -> Column:
    parts = [F.regexp_extract(text, f"(?i){SECTION}", k) for k in (1, 2, 3)]
    return reduce(lambda a, b: F.when(a != "", a).otherwise(b), parts)


def route(utterances: DataFrame, sections: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Adds intent, action, number and depth. sections(number) are those that resolve; without it all do."""
    raw = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    rows = utterances.withColumns({"action": action(raw), "chapter_no": F.regexp_extract(raw, f"(?i){CHAPTER}", 1), "section_no": section_number(raw)})
    resolves = F.lit(True)
    if sections is not None:
        known = sections.select(F.col("number").alias("section_no")).distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, "section_no", "left")
        resolves = F.col("known").isNotNull()
    bare = F.lower(F.regexp_replace(raw, r"^[ .?!]+|[ .?!]+$", ""))
    intent = (
        F.when(raw == "", "topic_qa")
        .when(F.col("action").isNotNull(), "control")
        .when(_has(raw, RECAP), "recap")
        .when(_has(raw, XREF), "xref_explore")
        .when(_has(raw, DEPENDS), "dependencies")
        .when(_has(raw, RESHOW) | _has(raw, AGAIN), "reshow")
        .when(_has(raw, BOOK), "book_overview")
        .when((F.col("chapter_no") != "") & ((F.col("section_no") == "") | ~F.contains(F.lower(raw), F.lit("section"))), "chapter_overview")
        .when((F.col("section_no") != "") & resolves, "section_overview")
        .when(_has(raw, FOLLOW_UP) | bare.isin(*SOLO), "follow_up")
        .otherwise("topic_qa")
    )
    number = F.when(F.col("intent") == "chapter_overview", F.col("chapter_no")).when(F.col("intent") == "section_overview", F.col("section_no")).otherwise("")
    depth = F.when(_has(raw, SHORT), "short").when(_has(raw, DEEP), "deep").otherwise("")
    rows = rows.withColumn("intent", intent).withColumn("number", number).withColumn("depth", depth)
    return rows.drop("chapter_no", "section_no", "known")
