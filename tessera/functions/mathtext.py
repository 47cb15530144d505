"""Mathematical text: reading aloud, spans, matrices, symbols.

Nested braces need a scan, so those functions are plain Python to be used through `column`, which runs them in Arrow batches; the rest are Column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.extraction import GREEK

SPANS = re.compile(r"\$\$(.+?)\$\$|\$([^$\n]+)\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
MATRIX = re.compile(r"\\begin\{([pbvBV]?matrix)\}(.*?)\\end\{\1\}", re.S)
DELIMITERS = {"matrix": "", "pmatrix": "(", "bmatrix": "[", "vmatrix": "|", "Bmatrix": "{", "Vmatrix": "||"}


def column(f: Callable, kind: str) -> Callable[[Column], Column]:
    """A text function as a Column function of the given type."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def brace_argument(text: str, at: int) -> tuple[str, int] | None:
    """The balanced {...} that begins at a place (without its braces) and the place after it."""
    if at >= len(text) or text[at] != "{":
        return None
    depth = 0
    for i in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return text[at + 1 : i], i + 1
    return None


def _commands(text: str, name: str, arguments: int, say: Callable[..., str]) -> str:
    """Replaces \\name{..}{..}, innermost last, from the left."""
    at = text.find("\\" + name)
    while at >= 0:
        place, found = at + len(name) + 1, []
        while len(found) < arguments and (got := brace_argument(text, place)):
            found.append(got[0])
            place = got[1]
        if len(found) == arguments:
            text = text[:at] + say(*found) + text[place:]
            at = text.find("\\" + name, at)
        else:
            at = text.find("\\" + name, at + 1)
    return text


def spoken(latex: str) -> str:
    """A formula as it is read aloud: fractions, roots, norms, powers, indices and Greek letters."""
    text = _commands(latex, "frac", 2, lambda a, b: f" {a} over {b} ")
    text = _commands(text, "sqrt", 1, lambda a: f" square root of {a} ")
    for mark in ("hat", "bar", "tilde", "vec", "dot"):
        text = _commands(text, mark, 1, lambda a, mark=mark: f" {a} {mark} ")
    text = re.sub(r"\\\|([^|]+)\\\||‖([^‖]+)‖", lambda m: f" norm of {m[1] or m[2]} ", text)
    text = re.sub(r"\^\{?\\?(?:top|T)\}?(?![A-Za-z])", " transpose ", text)
    text = re.sub(r"\^\{?2\}?(?![0-9])", " squared ", text)
    text = re.sub(r"\^\{?3\}?(?![0-9])", " cubed ", text)
    text = re.sub(r"\^\{([^{}]*)\}|\^(\w)", lambda m: f" to the power {m[1] or m[2]} ", text)
    text = re.sub(r"_\{([^{}]*)\}|_(\w)", lambda m: f" sub {m[1] or m[2]} ", text)
    for command, word in (("sum", "the sum of"), ("prod", "the product of"), ("int", "the integral of"), ("leq", "at most"), ("geq", "at least"), ("in", "in"), ("to", "to"), ("cdot", "times")):
        text = re.sub(rf"\\{command}(?![A-Za-z])", f" {word} ", text)
    text = re.sub(r"([A-Za-z])\(([^()]*)\)", r"\1 of \2", text)
    text = text.replace("=", " equals ").replace("+", " plus ")
    return " ".join(re.sub(r"[\\{}]", " ", text).split())


def unicode_text(latex: str) -> str:
    """Greek commands and simple powers and indices as Unicode characters."""

    def letter(m: re.Match) -> str:
        name = m[1].removeprefix("var")
        if m[1] not in GREEK:
            return m[0]
        size = "CAPITAL" if name[0].isupper() else "SMALL"
        return unicodedata.lookup(f"GREEK {size} LETTER {'LAMDA' if name.lower() == 'lambda' else name.upper()}")

    text = re.sub(r"\\([A-Za-z]+)", letter, latex)
    digits = lambda kind: {str(i): unicodedata.lookup(f"{kind} {w}") for i, w in enumerate("ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE".split())}
    up, down = digits("SUPERSCRIPT"), digits("SUBSCRIPT")
    text = re.sub(r"\^\{?([0-9]+)\}?", lambda m: "".join(up[c] for c in m[1]), text)
    return re.sub(r"_\{?([0-9]+)\}?", lambda m: "".join(down[c] for c in m[1]), text)


def latex_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, latex) of the formulas of a text."""
    return [(m.start(), m.end(), next(g for g in m.groups() if g is not None)) for m in SPANS.finditer(text)]


def matrix_literal(latex: str) -> tuple[int, int, list[list[str]], str] | None:
    """(rows, columns, cells, delimiter) of a matrix environment; short rows are filled with empty cells."""
    m = MATRIX.search(latex)
    if not m:
        return None
    cells = [[c.strip() for c in row.split("&")] for row in re.split(r"\\\\", m[2]) if row.strip()]
    wide = max(map(len, cells), default=0)
    return len(cells), wide, [r + [""] * (wide - len(r)) for r in cells], DELIMITERS[m[1]]


def label_class(label: Column) -> Column:
    """matrix, function, number, greek, symbol or word."""
    return (
        F.when(label.rlike(r"\\begin\{[pbvBV]?matrix\}"), "matrix")
        .when(label.rlike(r"^\s*\\?[A-Za-z]+\s*\([^)]*\)\s*$"), "function")
        .when(label.rlike(r"^\s*-?\d+(?:\.\d+)?\s*$"), "number")
        .when(label.rlike(r"^\s*\\(?:" + "|".join(sorted(GREEK)) + r")\s*$"), "greek")
        .when(label.rlike(r"^\s*[A-Za-z](?:_\{?\w+\}?)?\s*$"), "symbol")
        .otherwise("word")
    )
