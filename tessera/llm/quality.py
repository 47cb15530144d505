"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (shares of byte classes, repetition of words and lines,
stop words, lengths) are computed in Arrow batches.  Trees are grown level by level
on binned statistics with second-order gains of the logistic loss, as complete binary trees,
and flattened into arrays, so scoring a batch is ``depth`` rounds of numpy indexing
over all rows and trees at once.

Labels: at most ``max_rows`` labelled rows fit the trees, those with the smallest hash of
the doc_id (a documented bound, so the driver holds max_rows x statistics at
most); rows whose crc32(doc_id as text) mod ``folds`` is ``held`` are held out.  Every
document is scored.  Only the text enters a score.

Defined cases: null text is empty and is scored by the statistics of the empty text; a null
doc_id is never held out nor labelled; labels that repeat a doc_id count once (the
smallest), null ones not; without labels of both kinds every score is the share of label 1
(0.5 without any); repeated rows get equal scores; an empty table gives no rows; extra
columns are passed through by ``score_rows`` and ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .external import release

# Common words of English, German, French and Spanish.
COMMON = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or an they which one you were her all she there would their we him been
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie
    de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il avec ce son sont
    el y los del las por con su para como más pero sus o entre sin sobre""".split()
)
STATISTICS = (
    "log_bytes", "upper", "lower", "digit", "blank", "newline", "stop_sign", "shout_sign", "quote_bracket", "odd_sign", "other_byte", "byte_entropy",
    "log_words", "word_length", "distinct_words", "repeated_next", "common", "line_words", "distinct_lines", "short_lines", "longest_word", "shout_words",
    "first_half_distinct", "capital_words",
)


def _classes() -> np.ndarray:
    """By byte value: the class it counts in."""
    kind = np.full(256, 9, np.int64)
    for i, chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\x0b\x0c\r", b"\n", b".,;:", b"!?", b"\"'()[]{}<>"), 0):
        for c in chars:
            kind[c] = i
    kind[128:] = 8
    return kind


_KIND = _classes()


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_KIND, counts, 10) / n
    p = counts[counts > 0] / n
    words = text.split()
    w = max(len(words), 1)
    seen = set(words)
    lines = [x for x in text.split("\n") if x]
    k = max(len(lines), 1)
    half = words[: (w + 1) // 2]
    return [
        np.log1p(len(raw)), *share[[0, 1, 2, 3, 4, 5, 6, 7, 9, 8]], float(-(p * np.log2(p)).sum()),
        np.log1p(len(words)), len(text) / w, len(seen) / w, sum(map(str.__eq__, words, words[1:])) / w, sum(map(COMMON.__contains__, words)) / w, w / k,
        len(set(lines)) / k, sum(len(x) < 20 for x in lines) / k, float(max(map(len, seen), default=0)), sum(map(str.isupper, seen)) / max(len(seen), 1),
        len(set(half)) / max(len(half), 1), sum(map(str.istitle, seen)) / max(len(seen), 1),
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(x or "") for x in texts], np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Trees:
    """Complete binary trees in arrays: split feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.leaf) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees = np.arange(len(self.leaf))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        depth = self.leaf.shape[1].bit_length() - 1
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        z = self.base + self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 2.0, least: int = 8) -> Trees:
    if not len(y):
        return Trees(0.0, *(np.empty((0, 1)) for _ in range(3)))
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return Trees(base, *(np.empty((0, 1)) for _ in range(3)))
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, leaves))
    z = np.full(n, base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        cut = np.zeros((inner, 2), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            split = np.stack([np.zeros(width, np.int64), np.full(width, bins, np.int64)], 1)
            for j in range(d):
                at = node * bins + binned[:, j]
                sums = [np.cumsum(np.bincount(at, v, width * bins).reshape(width, bins), 1) for v in (g, h, np.ones(n))]
                (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                better = top > best + 1e-9
                best[better], split[better, 0], split[better, 1] = top[better], j, b[better]
            for q in range(width):
                j, b = split[q]
                feature[t, first + q] = j
                threshold[t, first + q] = edges[j][b] if b < len(edges[j]) else np.inf
            cut[first : first + width] = split
            own = cut[first + node]
            node = 2 * node + (binned[np.arange(n), own[:, 0]] > own[:, 1])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = -rate * gs / (hs + l2)
        z += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def held_out(doc_id: Column, folds: int = 4, held: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """Texts and labels of at most max_rows documents outside the held-out fold."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").alias("label_id")).agg(F.min(label_col).alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    return docs.join(F.broadcast(one), docs["doc_id"] == one["label_id"]).select(docs["doc_id"], docs["text"], "label")  # at most max_rows rows of 12 bytes


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000, **how) -> Trees:
    sample = labelled(docs, labels, label_col, max_rows)

    def run(batches):
        for b in batches:
            x = matrix(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = sample.mapInArrow(run, "doc_id bigint, label double, x array<double>").toArrow().sort_by("doc_id").to_pydict()
    return fit(np.array(got["x"], np.float64).reshape(-1, len(STATISTICS)), np.array(got["label"], np.float64), **how)


def score_rows(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "__score") -> DataFrame:
    """docs with one column more, the score (its name must be new)."""
    fields = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            score = np.concatenate([trees.score(matrix(texts[i : i + 1000])) for i in range(0, len(texts), 1000)]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, score_col])
        release()

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*fields.fields, T.StructField(score_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    texts = docs.select("doc_id", "text")
    trees = train(texts, labels, **how)
    return score_rows(texts, trees).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= threshold, 1).otherwise(0).alias("predicted")
    )
