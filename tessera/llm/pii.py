"""Personal data by weak supervision.

Candidates of every kind come from patterns.  Five labelers vote on each (+1, 0 for no
opinion, -1): the strict shape of the kind, its check rule (Luhn, octets, digit counts),
a gazetteer (top-level domains, calling codes, given names, street words ...), the words
around it, and how it is delimited.  Their vote patterns are counted over all documents
in one map-side combined aggregate, whose size depends on the number of labelers and
kinds and not on the corpus.  Expectation-maximisation over the counts estimates how often each
labeler casts which vote on what is personal data and what is not (its reliability), and each kind's rate; its posteriors train the final span
classifier, a logistic regression on votes, kind and shape, by Newton's method.  Base spans take part like
all others, though a second
pass keeps all of them, beside those other candidates that the classifier accepts.

All patterns are linear in the text (possessive, or anchored at a sign), so whole texts
of any length are read.  Nothing is shuffled but the counts.

Defined cases: null text is empty and has no spans; repeated rows give repeated results;
a corpus without candidates gets base spans only; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans with one start are listed.
KINDS = (*BASE, "ssn", "iban", "secret", "person", "address")
LABELERS = ("shape", "check", "gazetteer", "context", "edges")

# The base patterns' character classes.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What the other candidates and the labelers look for.
NUMBER = re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){1,4}(?![\w-]|\.[0-9])")
SPELLED = re.compile(r"(?<![\w.-])[A-Za-z0-9][A-Za-z0-9._-]*+ ?[\[(]?(?:at|@)[\])]? ?[A-Za-z0-9-]++(?: ?[\[(](?:dot|\.)[\])] ?[A-Za-z]{2,12}| dot [A-Za-z]{2,12})", re.I)
#: Every spelled address has one of these.
DOTTED = re.compile(r"[\[(](?:dot|\.)[\])]| dot ", re.I)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[0-9a-fA-F]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[bp])[_-][A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9+/_-])")
#: A capitalised word of Latin letters.
NAME = "[A-ZÀ-ÖØ-ÞŒŠŽ][a-zà-öø-ÿœšž]++"
TITLES = "(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|Sr|Sra|Srta)"
TLDS = frozenset("com org net edu gov io co de fr es uk eu info biz us ca ch at it nl".split())
GIVEN = frozenset(
    """adam agnes alan albert alexander alice alicia amanda amy ana andrea andreas andrew angela anna anne antoine antonio barbara benjamin bernard birgit brian camille carlos carmen
    caroline catherine charles charlotte chloé christian christine christopher claire clara claudia cristina daniel david deborah dennis diana diego dieter dominique donald donna edward
    elena elisabeth elizabeth émile emily emma eric ernst eva fernando francisco françois frank franz gabriel george gerhard hannah hans heike heinz helen helmut henri henry inés ingrid
    isabel jack jacques james jan jason javier jean jennifer jessica joachim johann john jorge josé joseph juan judith julia julien jürgen karen karin karl katherine kevin klaus laura
    lea léa linda lisa louis lucas lucía luis luisa manfred manuel marco margaret maria maría marie mark martha martin mary matthew michael michel miguel monika nancy nicolas nicole
    olivier pablo patricia patrick paul pedro peter philippe pierre rachel ralf raúl rebecca renate richard robert rosa ruth sabine samuel sandra sarah sophie stefan stephen susan susanne
    sylvie teresa thomas uwe víctor werner william wolfgang""".split()
)
TITLE = re.compile(rf"{TITLES}\b")
PERSON = re.compile(rf"(?<!\w)(?:{TITLES}\.? {NAME}(?:[ -]{NAME})*+|(?:{'|'.join(sorted(x.title() for x in GIVEN))})(?:[ -]{NAME})++)(?!\w)")
ADDRESS = re.compile(rf"(?<![\w.])[0-9]{{1,5}} (?:{NAME} )+?(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct)\b")
CUES = {
    "email": "mail e-mail email contact write correo",
    "ip": "ip host server address login client",
    "card": "card credit visa mastercard amex payment karte tarjeta carte",
    "phone": "phone tel call mobile fax telefon teléfono téléphone cell",
    "ssn": "ssn social security",
    "iban": "iban bank account konto cuenta compte",
    "secret": "token key secret password passwd api_key apikey auth",
    "person": "name dear sincerely signed contact",
    "address": "address street lives mailing ship",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
AGAINST = frozenset("version isbn issn page pages fig figure section chapter license doi eq table vol no".split())
#: Signs before and after a span that stands by itself (none: the text's ends).
OPENS, CLOSES = frozenset(["", *" \t\n\r\"'(<[:=,;"]), frozenset(["", *" \t\n\r\"')>].,:;!?"])
WORD = re.compile(r"[^\W\d_]+(?:_[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base kinds, leftmost and not overlapping within a kind, by start, then kind."""
    found = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := DOMAIN.match(text, after)):
            done = after = m.end()
            found.append((start, 0, done))
        at = text.find("@", after)
    if re.search("[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    found.sort()
    return found


def other_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the base spans, none overlapping one of them; of overlapping ones the first stays."""
    found = []
    if re.search("[0-9]", text):
        for m in NUMBER.finditer(text):
            d = digits_of(m[0])
            if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m[0]):
                found.append((m.start(), 4, m.end()))
            elif 9 <= len(d) <= 11:
                found.append((m.start(), 3, m.end()))
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() < 40 and 13 <= len(digits_of(m[0])) <= 19]
        found += [(m.start(), 5, m.end()) for m in IBAN.finditer(text)]
        found += [(m.start(), 6, m.end()) for m in SECRET.finditer(text)]
        found += [(m.start(), 8, m.end()) for m in ADDRESS.finditer(text)]
    if DOTTED.search(text):
        found += [(m.start(), 0, m.end()) for m in SPELLED.finditer(text)]
    found += [(m.start(), 7, m.end()) for m in PERSON.finditer(text)]
    kept, busy = [], sorted((s, e) for s, _, e in base)
    last = b = 0
    for s, k, e in sorted(found):
        while b < len(busy) and busy[b][1] <= s:
            b += 1
        if s >= last and not (b < len(busy) and busy[b][0] < e):
            kept.append((s, k, e))
            last = e
    return kept


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes, in order of LABELERS, and a coarse shape (length class, digit share)."""
    span, name, d = text[start:end], KINDS[kind], digits_of(text[start:end])
    groups = [x for x in re.split("[ .()-]+", span) if x]
    shape = 1 if base or name in ("ssn", "iban", "secret", "address", "person") else 0
    if name == "card" and not base:
        shape = 0 if len(d) in (13, 15, 16) else -1
    elif name == "phone" and not base:
        shape = 0 if len(groups) == 3 and len(d) == 10 else -1
    if name == "card":
        check = 1 if luhn(d) else -1
    elif name == "phone":
        check = 1 if 9 <= len(d) <= 15 else -1
    elif name == "iban":
        moved = span.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1 else -1
    elif name == "ssn":
        check = -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 1
    elif name == "secret":
        check = 1 if len(set(span)) >= 8 else -1
    else:
        check = 1 if base else 0
    if name == "person" and TITLE.match(span):
        check = 1
    words = [w.lower() for w in WORD.findall(span)]
    gazetteer = 0
    if name == "email":
        gazetteer = 1 if words and words[-1] in TLDS else -1
    elif name == "person":
        gazetteer = 1 if any(w in GIVEN for w in words) else 0
    elif name == "phone":
        gazetteer = 1 if base else 0
    elif name == "card":
        gazetteer = 1 if d[0] in "3456" else -1 if d[0] in "01789" else 0
    elif name == "address":
        gazetteer = 1
    around = {w.lower() for w in WORD.findall(text[max(0, start - 40) : start]) + WORD.findall(text[end : end + 20])}
    context = 1 if around & CUES[name] else -1 if around & AGAINST else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = -1 if left.isalnum() or right.isalnum() else 1 if left in OPENS and right in CLOSES else 0
    return shape, check, gazetteer, context, edges, min((end - start) // 8, 5), len(d) * 4 // max(1, end - start)


@dataclass
class SpanModel:
    reliability: dict[str, float]  # by labeler: the chance that a vote of +1 or -1 is right
    rate: dict[str, float]  # by kind
    weights: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-design(rows) @ self.weights)) if len(rows) else np.empty(0)


def design(rows: np.ndarray) -> np.ndarray:
    """One-hot columns of (kind, votes..., length class, digit share)."""
    rows = np.asarray(rows, np.int64).reshape(-1, 8)
    parts = [np.ones((len(rows), 1)), np.eye(len(KINDS))[rows[:, 0]]]
    parts += [np.eye(3)[rows[:, 1 + i] + 1] for i in range(5)]
    parts += [np.eye(6)[rows[:, 6]], np.eye(5)[np.minimum(rows[:, 7], 4)]]
    return np.concatenate(parts, 1)


def estimate(rows: np.ndarray, n: np.ndarray, rounds: int = 60) -> SpanModel:
    """EM over counted vote patterns (kind, five votes, shape), then the classifier on its posteriors."""
    rows = np.asarray(rows, np.int64).reshape(-1, 8)
    n = np.asarray(n, np.float64)
    v, kind = rows[:, 1:6], rows[:, 0]
    voted = v != 0
    q = 1 / (1 + np.exp(-1.5 * v @ np.array([1, 2, 1, 1, 1])))
    right = np.full(len(LABELERS), 0.8)
    rate = np.full(len(KINDS), 0.5)
    cast = np.eye(3)[v + 1]  # (pattern, labeler, vote)
    prior = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])  # of a vote of -1, 0, 1 for what is none and what is one
    for _ in range(rounds if len(rows) else 0):
        rate = (np.bincount(kind, n * q, len(KINDS)) + 5) / (np.bincount(kind, n, len(KINDS)) + 10)
        counts = np.einsum("yp,plv->lyv", np.stack([n * (1 - q), n * q]), cast) + prior
        chance = counts / counts.sum(2, keepdims=True)  # of each vote, by labeler, for what is none and what is one
        odds = np.log(rate[kind] / (1 - rate[kind])) + np.einsum("plv,lv->p", cast, np.log(chance[:, 1] / chance[:, 0]))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        agree = np.where(v > 0, q[:, None], 1 - q[:, None]) * voted
        right = ((n @ agree) + 8) / ((n @ voted) + 10)
    x = design(rows)
    w = np.zeros(x.shape[1])
    scale = n / max(n.sum(), 1) * 1000 if len(rows) else n
    for _ in range(25 if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (scale * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (scale * (p - q)) + 0.05 * w)
    return SpanModel(dict(zip(LABELERS, map(float, right), strict=True)), dict(zip(KINDS, map(float, rate), strict=True)), w)


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    base = base_spans(text)
    return [(*x, True) for x in base] + [(*x, False) for x in other_spans(text, base)]


def vote_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, votes and shape of the candidates of all documents, with their number n."""

    def run(batches):
        for batch in batches:
            counts = Counter((k, *votes(t, s, k, e, b)) for t in batch.column(0).to_pylist() if t for s, k, e, b in candidates(t))
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(map(list, counts)), pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pattern array<int>, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    got = vote_counts(docs, text_col).collect()  # at most kinds x 3^5 x 30 patterns
    got.sort(key=lambda r: r["pattern"])
    return estimate(np.array([r["pattern"] for r in got]), np.array([r["n"] for r in got]))


def find(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base, probability>> of every document (code points, end exclusive), by start, then kind."""
    model = model or train(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())])

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = candidates(text) if text else []
                if not found:
                    out.append([])
                    continue
                rows = np.array([(k, *votes(text, s, k, e, b)) for s, k, e, b in found])
                p = model.probability(rows)
                kept = sorted((s, k, e, b, float(x)) for (s, k, e, b), x in zip(found, p, strict=True) if b or x >= threshold)
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b, "probability": x} for s, k, e, b, x in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,probability:double>>")


def redact(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first is replaced."""
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = s["end"]
    return "".join([*parts, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: (s["kind"] == k) & (s["base"] if k in BASE else F.lit(True)))).cast("long").alias(f"n_{k}")
    number = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *map(count, KINDS), number, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
