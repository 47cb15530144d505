"""N-gram Jaccard join with a count-vector R-tree.

Two documents link when the Jaccard similarity of their sets of 5-word shingles reaches
the threshold.  All links are found, none is guessed:

1. Shingles are ordered by how common they are (rare ones first; counts by hash in a table of fixed size
   over all documents).  A pair that links shares one of the rarest
   floor((1 - threshold) * size) + 1 shingles of either set, so only these are dealt, by hash, into
   cells.  Copies of a set that meet in a task are dealt once.
   A cell counts for a document only if it holds another of like size and the document is in as many such cells as a link would need.
2. Each document is verified against the one hub (first document of a cell) that it
   shares most cells with.  That joins groups of copies by as many checks as they have
   members, and no pairs of them are ever listed.
3. In cells that still hold several components, documents are points: their shingles are
   hashed into groups and the groups' counts are the coordinates.  An R-tree over the points (boxes are
   coordinate-wise maxima, with size ranges) is joined with itself; the sum of coordinate
   minima bounds the overlap from above, and node pairs, then document pairs, that cannot
   reach the threshold are dropped.  Of what survives a task hands on a forest, which would
   connect the same components as all the pairs, so a family of copies costs as many pairs as it has members.
4. The forest is verified on the sets, and components are joined by contraction: every round at least halves the nodes.
5. Where a pair of the forest failed, pairs that it stood for may link.  So the documents of a tree that did not become one
   component meet once more, now with their sets: survivors of the R-tree are verified
   at once, and components that are joined need no more pairs.

Cells are taken by rarity, so a passage that a third of all documents share is met only by
documents made of little else.  Shuffled are about 12 bytes per dealt shingle, the
compressed texts once for each of the two verifications and once more for each check of a document, and
count vectors (size to twice that of small numbers) of documents in shared cells.  The documents of one cell that come
as far as step 3 or 5 are held by one task; hubs with many documents meet them in several.

Shingles are compared by 64-bit hashes.

Defined cases: null or blank texts have an empty set, link with nothing and are their own
component; texts under five words are one shingle; rows that share a doc_id are one node: the
links of each count for all; a null doc_id is a node, smaller than the others, shown
as null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .external import BYTE, NONE, ODD, RUN, Sorter, dealt, doc_group, expand, mix, record, release

#: Bytes of text of one array operation, and of one group of documents or shingles on average.
CHUNK = 1 << 20
GROUP_BYTES = 8 << 20
#: Documents that meet the set of one hub in a task, roughly.
HUB_ROWS = 4096
#: Documents with labels that may be broadcast (16 bytes each).
LABELS = 500_000
#: Counters of shingles by hash.
COUNTERS = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK + (1 << 16), ODD[0], np.uint64)]))
INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK + (1 << 16), np.uint64(pow(int(ODD[0]), -1, 2**64)), np.uint64)]))

CELL = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("part", "<i8"), ("n", "<i4")])
MEMBER = np.dtype([*CELL.descr, ("hub", "<i8"), ("hub_part", "<i8"), ("hub_n", "<i4"), ("need", "<i4"), ("size", "<i4")])
PAIR = np.dtype([("doc", "<i8"), ("part", "<i8"), ("doc2", "<i8"), ("part2", "<i8")])


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of lower-cased bytes; long data in pieces cut at blanks."""
    hashes, starts = [], []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            blank = np.flatnonzero(SPACE[data[max(at, end - (1 << 16)) : end]])
            if len(blank):
                end = max(at, end - (1 << 16)) + int(blank[-1]) + 1
            else:  # no blank in a long stretch: go on to the next one
                ahead = np.flatnonzero(SPACE[data[end:]])
                end = end + int(ahead[0]) + 1 if len(ahead) else n
        part = data[at:end]
        power, inverse = POWER, INVERSE
        if len(part) >= len(POWER):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(part), ODD[0], np.uint64)]))
            inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(part), np.uint64(pow(int(ODD[0]), -1, 2**64)), np.uint64)]))
        inside = np.concatenate([[False], ~SPACE[part], [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = turns[::2], turns[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[part] * power[: len(part)], dtype=np.uint64)])
        hashes.append(mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * ODD[1]))
        starts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each (UTF-8) text."""
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    words, starts = word_hashes(data)
    doc = np.searchsorted(begins, starts, "right") - 1
    counts = np.bincount(doc, minlength=len(texts))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= size:
        grams = sum(words[k : len(words) - size + 1 + k] * ODD[2 + k % 8] + np.uint64(k) for k in range(size))
        own = np.flatnonzero(doc[: len(grams)] == doc[size - 1 :])
        grams, owner = mix(grams[own]), doc[own]
    else:
        grams, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = []
        for d in short:
            h = np.uint64(counts[d])
            for w in words[offsets[d] : offsets[d + 1]]:
                h = mix(np.array([h], np.uint64) * ODD[3] + w)[0]
            whole.append(h)
        grams, owner = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]) if len(grams) else np.empty(0, bool)
    grams, owner = grams[fresh], owner[fresh]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [grams[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def prefix(grams: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles, of which a linking set shares one."""
    n = len(grams)
    keep = n - -(-percent * n // 100) + 1
    return grams[np.argsort(levels[(grams >> np.uint64(44)).astype(np.int64)], kind="stable")[:keep]] if n else grams


def count_vector(grams: np.ndarray) -> np.ndarray:
    """Shingles per hash group; the number of groups, a power of two, follows the size of the set."""
    bits = max(len(grams), 8).bit_length()
    while True:
        c = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if c.max(initial=0) < 256:
            return c.astype(np.uint8)
        bits += 1


def folded(c: np.ndarray, groups: int) -> np.ndarray:
    """A count vector (or rows of them) with fewer groups."""
    return c.reshape(*c.shape[:-1], groups, -1).sum(-1, dtype=np.int32) if c.shape[-1] != groups else c.astype(np.int32)


def least_overlap(a, b, percent: int):
    """Shared shingles that sets of sizes a and b need: x * 100 >= percent * (a + b - x)."""
    return -(-percent * (a + b) // (100 + percent))


class Union:
    """Disjoint sets of numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.find(x)] = self.find(y)


class Node:
    """A box of the R-tree: points (rows) or nodes below it, the rows' count vectors, coordinate-wise maxima, sizes, and a component once it is the only one."""

    __slots__ = ("children", "counts", "high", "low", "only", "rows", "top")

    def __init__(self, rows, children, counts, top, low, high):
        self.rows, self.children, self.counts, self.top, self.low, self.high, self.only = rows, children, counts, top, low, high, None

    def component(self, comp: list[int], union: Union) -> int | None:
        if self.only is None:
            if self.children is None:
                roots = {union.find(comp[i]) for i in self.rows}
            else:
                roots = {k.component(comp, union) for k in self.children}
            if len(roots) > 1 or None in roots:
                return None
            self.only = roots.pop()
        self.only = union.find(self.only)
        return self.only


def build(rows: list[int], n: np.ndarray, vectors: list[np.ndarray], turn: int = 0, fan: int = 12) -> Node:
    """Bulk-loads an R-tree: points in order of rough size and of some coordinates (from turn on), fan to a node."""
    lead = lambda v: v[turn % len(v) :][:4].tobytes()
    rough = (np.log2(np.maximum(n, 1)) * 6).astype(int)
    order = sorted(range(len(rows)), key=lambda x: (rough[x], lead(vectors[x]), int(n[x])))
    level = []
    for lo in range(0, len(order), fan):
        some = order[lo : lo + fan]
        groups = min(len(vectors[x]) for x in some)
        counts = np.stack([folded(vectors[x], groups) for x in some]).astype(np.uint16)
        level.append(Node([rows[x] for x in some], None, counts, counts.max(0), int(n[some].min()), int(n[some].max())))
    while len(level) > 1:
        above = []
        for lo in range(0, len(level), fan):
            kids = level[lo : lo + fan]
            groups = min(len(k.top) for k in kids)
            above.append(Node(None, kids, None, np.max([folded(k.top, groups) for k in kids], 0), min(k.low for k in kids), max(k.high for k in kids)))
        level = above
    return level[0]


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


def may_link(a: Node, b: Node, percent: int) -> bool:
    low, high = (a, b) if a.low <= b.low else (b, a)
    if 100 * low.high < percent * high.low:  # sizes too far apart
        return False
    return overlap_bound(a.top, b.top) >= least_overlap(a.low, b.low, percent)


def survivors(a: Node, b: Node, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of points of two leaves whose bound allows a link, the most alike first."""
    groups = min(a.counts.shape[1], b.counts.shape[1])
    x, y = folded(a.counts, groups).astype(np.uint16), folded(b.counts, groups).astype(np.uint16)
    shared = np.minimum(x[:, None, :], y[None, :, :]).sum(-1, dtype=np.int64)
    na, nb = sizes[a.rows].astype(np.int64)[:, None], sizes[b.rows].astype(np.int64)[None, :]
    good = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (shared >= least_overlap(na, nb, percent))
    if a is b:
        good &= np.triu(np.ones(good.shape, bool), 1)
    i, j = np.nonzero(good)
    likeness = shared[i, j] / np.maximum(1, (na + nb)[i, j] - shared[i, j])
    return [(a.rows[i[k]], b.rows[j[k]]) for k in np.argsort(-likeness, kind="stable")]


def tree_join(root: Node, sizes: np.ndarray, comp: list[int], union: Union, percent: int, accept) -> Iterator[tuple[int, int]]:
    """Self-join of the R-tree: pairs that survive, are of different components and are accepted; each joins its components."""
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        only = a.component(comp, union)
        if only is not None and only == (b.component(comp, union) if b is not a else only):
            continue
        if a is not b and not may_link(a, b, percent):
            continue
        if a.children is None and b.children is None:
            for i, j in survivors(a, b, sizes, percent):
                if union.find(comp[i]) != union.find(comp[j]) and accept(i, j):
                    union.join(comp[i], comp[j])
                    yield i, j
        elif a is b:
            kids = a.children
            stack += [(kids[x], kids[y]) for x in range(len(kids) - 1) for y in range(len(kids) - 1, x, -1)]
            stack += [(k, k) for k in kids]  # first what is alike
        elif b.children is None or (a.children is not None and len(a.children) >= len(b.children)):
            stack += [(k, b) for k in a.children]
        else:
            stack += [(a, k) for k in b.children]


def candidate_pairs(n: np.ndarray, comp: np.ndarray, vectors: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Every pair of points of different components that survives."""
    found: list[tuple[int, int]] = []
    _, comp = np.unique(comp, return_inverse=True)
    for _ in tree_join(build(list(range(len(n))), n, vectors), n, comp.tolist(), Union(len(n)), percent, lambda i, j: found.append((i, j))):
        pass  # none is accepted, so none joins components
    return found


def forest(cells: list[np.ndarray], n: np.ndarray, comp: np.ndarray, vector, percent: int, accept, turn: int = 0) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Joins the R-tree over each cell's points: pairs that connect what all accepted pairs would, and (point, tree) of the points of components that were joined.

    cells: of each point; vector(i): its count vector. Cells with the same points are joined once.
    """
    of = np.repeat(np.arange(len(cells)), list(map(len, cells)))
    cell = np.concatenate(cells) if cells else np.empty(0, np.uint64)
    order = np.lexsort((of, cell))
    cell, of = cell[order], of[order]
    if not len(of):
        return [], []
    _, comp = np.unique(comp, return_inverse=True)
    cuts = np.flatnonzero(np.diff(cell, prepend=cell[:1] ^ np.uint64(1)) != 0)
    ends = np.append(cuts[1:], len(of))
    members = comp[of]
    mixed = np.minimum.reduceat(members, cuts) != np.maximum.reduceat(members, cuts)
    kind = np.stack([np.add.reduceat(mix((of.astype(np.uint64) + np.uint64(1)) * ODD[k]), cuts) for k in (6, 7)], 1)
    _, once = np.unique(kind, axis=0, return_index=True)
    once = once[mixed[once]]
    once = once[np.argsort((ends - cuts)[once], kind="stable")[::-1]]  # large cells join most
    comp, union = comp.tolist(), Union(int(comp.max()) + 1)
    found: list[tuple[int, int]] = []
    for k in once:
        rows = of[cuts[k] : ends[k]]
        if len(rows) == 2:
            i, j = int(rows[0]), int(rows[1])
            small, large = sorted((int(n[i]), int(n[j])))
            if 100 * small < percent * large or union.find(comp[i]) == union.find(comp[j]) or overlap_bound(vector(i), vector(j)) < least_overlap(small, large, percent):
                continue
            if accept(i, j):
                union.join(comp[i], comp[j])
                found.append((i, j))
            continue
        if len({union.find(comp[i]) for i in rows}) == 1:
            continue
        root = build(rows.tolist(), n[rows], [vector(i) for i in rows], turn)
        found += tree_join(root, n, comp, union, percent, accept)
    joined = {comp[i] for pair in found for i in pair}
    return found, [(i, union.find(c)) for i, c in enumerate(comp) if c in joined]


def least_cells(a, b, percent: int):
    """Cells that linking sets of sizes a and b share: of their first shared shingles in order so many lie in both prefixes."""
    return np.maximum(1, least_overlap(a, b, percent) + 1 - -(-percent * np.maximum(a, b) // 100))


def cells_needed(cell: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """For each member of a cell the least number of cells it shares with any member it could link with; 0 if sizes rule all out."""
    order = np.lexsort((n, cell))
    at, size = cell[order].astype(np.int64) << 32, n[order].astype(np.int64)
    key = at + size
    low, high = np.searchsorted(key, at + -(-percent * size // 100)), np.searchsorted(key, at + 100 * size // percent, "right")
    need = np.minimum(least_cells(size, size[low], percent), least_cells(size, size[high - 1], percent)) - 1  # one less, for the roundings
    out = np.empty(len(n), np.int64)
    out[order] = np.where(high - low > 1, np.maximum(need, 1), 0)
    return out


def enough(need: np.ndarray) -> np.ndarray:
    """Which cells of one document can matter: those that need no more cells than there are of such."""
    keep = np.ones(len(need), bool)
    while True:
        new = need <= keep.sum()
        if (new == keep).all():
            return keep
        keep &= new


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """v, label (the smallest node reachable) of the nodes of edges(a, b), by contraction."""
    steps = []
    edges = settle(edges.filter("a <> b").distinct())
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        step = settle(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("to")))
        steps.append(step)
        left = edges.join(step.toDF("a", "a2"), "a").join(step.toDF("b", "b2"), "b")
        edges = settle(left.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a <> b").distinct())
    if not steps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    labels = steps[-1].toDF("v", "label")
    for step in reversed(steps[:-1]):
        later = labels.toDF("to", "label")
        labels = settle(step.join(later, "to", "left").select("v", F.coalesce("label", "to").alias("label")))
    return labels


def share_ids(ids: DataFrame) -> bool:
    return ids.groupBy(ids.columns[0]).count().filter("count > 1").limit(1).count() > 0


def link(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, apart: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; if apart, doc, part and first (doc, part) of its component, where texts of one id are nodes of their own."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = apart or share_ids(source.select("doc"))
    node = lambda d, p: F.struct(F.col(d).alias("doc"), F.col(p).alias("part")) if apart else F.col(d)
    source = source.select(F.coalesce("doc", F.lit(int(NONE))).alias("doc"), (F.xxhash64("text") if shared else F.lit(0).cast("bigint")).alias("part"), "text")
    blobs = "g int, blob binary"

    def sets_of(batches) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], int]]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch.column(2)]
            lo, held = 0, 0
            for hi, t in enumerate(texts, 1):
                held += len(t)
                if held >= CHUNK or hi == len(texts):
                    yield batch.column(0).to_numpy()[lo:hi], batch.column(1).to_numpy()[lo:hi], shingle_sets(texts[lo:hi], size), held
                    lo, held = hi, 0

    facts_schema = "doc bigint, part bigint, n bigint, d1 bigint, d2 bigint, bytes bigint, g int, blob binary"

    def measure(batches):
        """Size and digest of each set, and this task's counts of shingles by hash."""
        counters = np.zeros(COUNTERS, np.int64)
        names = [x.split()[0] for x in facts_schema.split(", ")]
        for doc, part, sets, held in sets_of(batches):
            every = np.concatenate(sets)
            counters += np.bincount((every >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
            n = np.array(list(map(len, sets)))
            cuts = np.concatenate([[0], np.cumsum(n)])
            d1, d2 = (np.concatenate([[np.uint64(0)], np.cumsum(mix(every * ODD[k]), dtype=np.uint64)]) for k in (4, 5))
            d1, d2 = ((d[cuts[1:]] - d[cuts[:-1]]).view(np.int64) for d in (d1, d2))
            rows = len(n)
            size_of = np.zeros(rows, np.int64)
            size_of[0] = held
            yield pa.RecordBatch.from_arrays([*map(pa.array, (doc, part, n, d1, d2, size_of)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        slices = counters.reshape(64, -1)
        some = [i for i in range(64) if slices[i].any()]
        zero = pa.array(np.zeros(len(some), np.int64))
        yield pa.RecordBatch.from_arrays([zero] * 6 + [pa.array([i + 64 * (TaskContext.get().partitionId() % 64) for i in some], pa.int32()), pa.array([zstandard.compress(slices[i].tobytes(), 1) for i in some], pa.binary())], names)
        release()

    def summed(modulus: int):
        def run(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(zstandard.decompress(b.as_py()), np.int64) for b in table["blob"])
            return pa.table({"g": pa.array([table["g"][0].as_py() % modulus], pa.int32()), "blob": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

        return run

    facts = settle(source.mapInArrow(measure, facts_schema))
    counted = facts.filter("g IS NOT NULL").select("g", "blob").groupBy("g").applyInArrow(summed(64), blobs).groupBy("g").applyInArrow(summed(64), blobs)
    counters = np.zeros((64, COUNTERS // 64), np.int64)
    for r in counted.collect():  # 64 slices of the table, whose size is fixed
        counters[r["g"]] = np.frombuffer(zstandard.decompress(r["blob"]), np.int64)
    counters = counters.ravel()
    levels = np.maximum(0, np.log2(np.maximum(counters, 1) / max(1.0, counters.mean()))).astype(np.uint8)
    sizes = facts.filter("g IS NULL").select("doc", "part", "n", "d1", "d2")
    total = facts.agg(F.sum("bytes")).first()[0] or 0
    groups = max(64, -(-total // group_bytes))
    shown = docs.sparkSession.sparkContext.broadcast(levels)  # COUNTERS bytes

    classes = sizes.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min(node("doc", "part")).alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    classes = settle(classes)
    hot = max(1_000, sizes.count() // 256)  # fewer than 256 classes can have more members
    same = sizes.join(F.broadcast(classes.filter(F.col("c") > hot)), ["n", "d1", "d2"]).unionByName(sizes.join(classes.filter(F.col("c") <= hot), ["n", "d1", "d2"]))
    same = same.select(F.col("rep").alias("a"), node("doc", "part").alias("b")).filter("a <> b")

    def deal(batches):
        """The rarest shingles of each set; sets that were met in this batch of texts are dealt once."""
        level, held, size_held, met = shown.value, [], 0, {}

        def flush():
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["part"], rows["doc"]))]
            return record(list(dealt((rows["hash"] % np.uint64(groups)).astype(np.int32), rows)))

        for doc, part, sets, _ in sets_of(batches):
            for d, p, s in zip(doc, part, sets, strict=True):
                key = s.tobytes() if len(s) < 8 else (len(s), int(mix(s).sum(dtype=np.uint64)), int(s[0]))
                if not len(s) or key in met:
                    continue
                met[key] = True
                few = prefix(s, level, percent)
                rows = np.empty(len(few), CELL)
                rows["hash"], rows["doc"], rows["part"], rows["n"] = few, d, p, len(s)
                held.append(rows)
                size_held += len(rows)
            if size_held >= RUN // 2:
                yield flush()
                held, size_held, met = [], 0, {}
        if held:
            yield flush()
        held, met = [], {}
        release()

    def cells(table: pa.Table) -> pa.Table:
        """Members of cells with several documents, each with the cell's hub, dealt by document."""
        sorter = Sorter(CELL, keys=("doc", "part"))
        for blob in table["blob"]:
            sorter.add(expand(blob.as_py(), CELL))
        pairs = []
        for rows in sorter.blocks():
            same = np.concatenate([[True], np.any([rows[c][1:] != rows[c][:-1] for c in ("hash", "doc", "part")], axis=0)])
            rows = rows[same]
            first = np.flatnonzero(np.diff(rows["hash"], prepend=rows["hash"][:1] ^ np.uint64(1)) != 0)
            group = np.repeat(np.arange(len(first)), np.diff([*first, len(rows)]))
            need = cells_needed(group, rows["n"], percent)
            many = need > 0
            out = np.empty(int(many.sum()), MEMBER)
            for c in CELL.names:
                out[c] = rows[c][many]
            hub = rows[first[group[many]]]
            out["hub"], out["hub_part"], out["hub_n"] = hub["doc"], hub["part"], hub["n"]
            out["need"], out["size"] = need[many], np.bincount(group, minlength=len(first))[group[many]]
            pairs += list(dealt(doc_group(out["doc"], out["part"], groups), out))
        return pa.Table.from_batches([record(pairs)])

    def compress(batches):
        for batch in batches:
            group = doc_group(batch.column(0).to_numpy(), batch.column(1).to_numpy(), groups)
            z = [zstandard.compress(x.as_buffer() if x.as_buffer().size else b"", 1) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["d", "doc", "part", "z"])
        release()

    texts = source.mapInArrow(compress, "d int, doc bigint, part bigint, z binary")

    def wanted_texts(texts: pa.Table, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], bytes]:
        """Compressed texts of the wanted documents."""
        found: dict[tuple[int, int], bytes] = {}
        for doc, part, z in zip(texts["doc"].to_pylist(), texts["part"].to_pylist(), texts["z"], strict=True):
            if (doc, part) in wanted and (doc, part) not in found:
                found[doc, part] = z.as_py()
        return found

    def sets_in(blobs) -> Iterator[np.ndarray]:
        """The sets of compressed texts, hashed some at a time."""
        held, size_held = [], 0
        for blob in blobs:
            held.append(zstandard.decompress(blob))
            size_held += len(held[-1])
            if size_held >= CHUNK:
                yield from shingle_sets(held, size)
                held, size_held = [], 0
        if held:
            yield from shingle_sets(held, size)

    # What travels (sets as compressed texts, a third of their hashes): role 0 a set on its way to a check, 1 the set it is held against,
    # 2 a document's point (n in doc2, width in part2; count vector, digest of the set, its cells), 3 a link that was found, 4 a pair to check, 5 a set that is kept.
    sent_schema = "role int, g int, doc bigint, part bigint, doc2 bigint, part2 bigint, blob binary"
    sent_names = [x.split()[0] for x in sent_schema.split(", ")]
    sent_kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]

    def sent(rows: list[tuple]) -> pa.Table:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.table({n: pa.array(c, k) for n, c, k in zip(sent_names, columns, sent_kinds, strict=True)})

    def group_of(doc: int, part: int, share: int = 0) -> int:
        """The group of a document; a hub with many documents has several."""
        return int((int(doc_group(np.array([doc], np.int64), np.array([part], np.int64), groups)[0]) + share * 7_919) % groups)

    def shares(size: int) -> int:
        return 1 + size // HUB_ROWS

    def choose(key, members: pa.Table, texts: pa.Table) -> pa.Table:
        """Sends each document's set to its most shared hub, hubs' sets to themselves, and keeps count vectors."""
        if not members.num_rows:
            return sent([])
        rows = np.concatenate([expand(b.as_py(), MEMBER) for b in members["blob"]])
        rows = rows[np.lexsort((rows["part"], rows["doc"]))]
        cuts = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["part"][1:] != rows["part"][:-1])]))
        rows = rows[np.concatenate([enough(rows["need"][a:b]) for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)])]
        if not len(rows):
            return sent([])
        held = wanted_texts(texts, set(zip(rows["doc"].tolist(), rows["part"].tolist(), strict=True)))
        sets = dict(zip(held, sets_in(held.values()), strict=True))
        out = []
        rows = rows[np.lexsort((rows["hub_part"], rows["hub"], rows["part"], rows["doc"]))]
        new = np.concatenate([[True], np.any([rows[c][1:] != rows[c][:-1] for c in ("doc", "part", "hub", "hub_part")], axis=0)])
        at = np.flatnonzero(new)
        best: dict[tuple[int, int], tuple] = {}
        for r, c, largest in zip(rows[at], np.diff([*at, len(rows)]), np.maximum.reduceat(rows["size"], at).tolist(), strict=True):
            me, hub = (int(r["doc"]), int(r["part"])), (int(r["hub"]), int(r["hub_part"]))
            if me == hub:
                if me in sets and c >= least_cells(int(r["n"]), int(r["n"]), percent):
                    out += [(1, g, *me, *me, held[me]) for g in {group_of(*me, k) for k in range(shares(largest))}]
                continue
            small, large = sorted((int(r["n"]), int(r["hub_n"])))
            if 100 * small >= percent * large and c >= least_cells(small, large, percent):
                best[me] = max(best.get(me, (0,)), (int(c), -hub[0], -hub[1], largest))
        for me, (_, hub, hub_part, largest) in best.items():
            if me in sets:
                share = int(mix(np.array([me[0] ^ me[1]], np.int64).astype(np.uint64))[0]) % shares(largest)
                out.append((0, group_of(-hub, -hub_part, share), *me, -hub, -hub_part, held[me]))
        own = key[0].as_py()
        cuts = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["part"][1:] != rows["part"][:-1])]))
        for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            me = (int(rows["doc"][a]), int(rows["part"][a]))
            if me in sets:
                vector, digest = count_vector(sets[me]), np.sum(mix(sets[me] * ODD[4]), dtype=np.uint64).tobytes()
                # a link shares this many cells or more, so it shares one that is not among the last ones of either document
                some = np.sort(rows["hash"][a:b])[: b - a + 1 - int(rows["need"][a:b].min())]
                out.append((2, own, *me, len(sets[me]), len(vector), zstandard.compress(vector.tobytes() + digest + some.tobytes(), 1)))
        return sent(out)

    def check_hubs(table: pa.Table) -> pa.Table:
        """The links to hubs (role 3)."""
        table = table.sort_by([("doc2", "ascending"), ("part2", "ascending"), ("role", "descending")])
        role, g, doc, part, hub, hub_part = (table[c].to_numpy() for c in sent_names[:6])
        found, last, hub_set = [], None, None
        for i, own in enumerate(sets_in(x.as_py() for x in table["blob"])):
            if (hub[i], hub_part[i]) != last:
                last, hub_set = (hub[i], hub_part[i]), None
            if role[i]:
                hub_set = own
            elif hub_set is not None and linked(own, hub_set, percent):
                found.append((3, g[i], doc[i], part[i], hub[i], hub_part[i], None))
        return sent(found)

    members = source.mapInArrow(deal, blobs).groupBy("g").applyInArrow(cells, blobs)
    chosen = settle(members.groupBy("g").cogroup(texts.groupBy("d")).applyInArrow(choose, sent_schema))
    near = chosen.filter("role < 2").groupBy("g").applyInArrow(check_hubs, sent_schema).select(node("doc", "part").alias("a"), node("doc2", "part2").alias("b"))
    early = components(near.unionByName(same))

    # points: documents of shared cells with their component and count vector, dealt by cell
    component = F.coalesce("label", node("doc", "part"))
    few = early.limit(LABELS + 1).count() <= LABELS  # then they are broadcast, else joined by a shuffle
    points = chosen.filter("role = 2").join(F.broadcast(early) if few else early, node("doc", "part") == F.col("v"), "left").select("doc", "part", F.col("doc2").alias("n"), (F.xxhash64(component) if apart else component).alias("comp"), F.col("part2").alias("wide"), "blob")
    # a document goes to each group of cells once, with those of its cells that are there
    cell_schema = "g int, doc bigint, part bigint, n int, comp bigint, digest bigint, cells binary, vector binary"
    point_groups = max(16, groups // 4)  # few cells are left

    def spread(batches):
        for batch in batches:
            out, met = [], set()
            for r in sorted(batch.to_pylist(), key=lambda r: (r["doc"], r["part"])):
                raw = zstandard.decompress(r["blob"])
                digest, own = int(np.frombuffer(raw, np.int64, 1, r["wide"])[0]), np.frombuffer(raw, np.uint64, offset=r["wide"] + 8)
                if (r["comp"], r["n"], digest) in met:  # of copies, which are of one component, one stands for all
                    continue
                met.add((r["comp"], r["n"], digest))
                vector = zstandard.compress(raw[: r["wide"]], 1)
                to = (own % np.uint64(point_groups)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                at = np.flatnonzero(np.diff(to[order], prepend=-1))
                for lo, hi in zip(at, [*at[1:], len(own)], strict=True):
                    out.append((int(to[order[lo]]), r["doc"], r["part"], r["n"], r["comp"], digest, own[order[lo:hi]].tobytes(), vector))
                if len(out) >= 10_000:
                    yield points_of(out)
                    out = []
            if out:
                yield points_of(out)
        release()

    def points_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in cell_schema.split(", ")])

    marked_schema = "doc bigint, part bigint, doc2 bigint, part2 bigint, g int, tree int"
    marked_names = [x.split()[0] for x in marked_schema.split(", ")]

    def residual(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A forest of the pairs of different components that may link, by an R-tree over each cell, and (g and tree given) the documents of each tree."""
        order = np.lexsort((table["part"].to_numpy(), table["doc"].to_numpy()))
        _, first = np.unique(np.stack([table[c].to_numpy()[order].astype(np.int64) for c in ("comp", "n", "digest")], 1), axis=0, return_index=True)
        table = table.take(pa.array(order[np.sort(first)]))  # one of copies, which are of one component
        stored, memory = table["vector"], {}

        def vector(i: int) -> np.ndarray:
            if i not in memory:
                memory[i] = np.frombuffer(zstandard.decompress(stored[int(i)].as_py()), np.uint8)
            return memory[i]

        cells_of = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["cells"]]
        n, comp, doc, part = (table[c].to_numpy() for c in ("n", "comp", "doc", "part"))
        edges, trees = forest(cells_of, n, comp, vector, percent, lambda i, j: True, 5 * key[0].as_py())
        i, j = np.array(edges, np.int64).reshape(-1, 2).T
        swap = (doc[i] > doc[j]) | ((doc[i] == doc[j]) & (part[i] > part[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        k, tree = np.array(trees, np.int64).reshape(-1, 2).T
        columns = [np.concatenate([x[y], x[k]]) for x, y in ((doc, i), (part, i), (doc, j), (part, j))]
        none = pa.nulls(len(i), pa.int32())
        marks = [pa.concat_arrays([none, pa.array(x, pa.int32())]) for x in (np.full(len(k), key[0].as_py()), tree)]
        return pa.table([*map(pa.array, columns), *marks], marked_names)

    pair_schema = "doc bigint, part bigint, doc2 bigint, part2 bigint"
    traced = settle(points.mapInArrow(spread, cell_schema).groupBy("g").applyInArrow(residual, marked_schema))
    pairs = traced.filter("tree IS NULL").select(*PAIR.names).distinct()
    marks = traced.filter("tree IS NOT NULL").select("doc", "part", "g", "tree")

    # verification, in the group of a pair's first document: each set goes there once, however many pairs it is in
    def ask(batches):
        for b in batches:
            d, p, d2, p2 = (b.column(i).to_numpy() for i in range(4))
            own = (d == d2) & (p == p2)  # documents of trees: their sets are kept
            for a, ap, role in ((d, p, np.where(own, 2, 0)), (d2[~own], p2[~own], 1)):
                rows = b if len(a) == len(d) else b.filter(pa.array(~own))
                yield pa.RecordBatch.from_arrays([pa.array(doc_group(a, ap, groups), pa.int32()), pa.array(np.full(len(a), role, np.int32) if np.isscalar(role) else role.astype(np.int32)), *rows.columns], ["q", "role", *PAIR.names])

    def answer(asked: pa.Table, texts: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        wanted: dict[tuple[int, int], set[int]] = {}
        kept: set[tuple[int, int]] = set()
        out = []
        for r in rows:
            me = (r["doc"], r["part"]) if r["role"] != 1 else (r["doc2"], r["part2"])
            to = wanted.setdefault(me, set())
            if r["role"] == 2:
                kept.add(me)
                continue
            target = group_of(r["doc"], r["part"])
            to.add(target)
            if r["role"] == 0:
                out.append((4, target, r["doc"], r["part"], r["doc2"], r["part2"], None))
        for me, blob in (wanted_texts(texts, set(wanted)) if rows else {}).items():
            out += [(0, target, *me, *me, blob) for target in sorted(wanted[me])]
            if me in kept:
                out.append((5, group_of(*me), *me, *me, blob))
        return sent(out)

    def check_pairs(table: pa.Table) -> pa.Table:
        """The links among the pairs (role 3); sets that are kept (5) pass."""
        kept = table.filter(pa.compute.equal(table["role"], 5))
        sets = {(r["doc"], r["part"]): r["blob"] for r in table.filter(pa.compute.equal(table["role"], 0)).to_pylist()}
        found, last, own = [], None, None
        for r in sorted(table.filter(pa.compute.equal(table["role"], 4)).to_pylist(), key=lambda r: (r["doc"], r["part"])):
            me, other = (r["doc"], r["part"]), (r["doc2"], r["part2"])
            if me != last:
                last, own = me, next(sets_in([sets[me]]))
            if linked(own, next(sets_in([sets[other]])), percent):
                found.append((3, r["g"], *me, *other, None))
        return pa.concat_tables([kept, sent(found)])

    def settle_tree(table: pa.Table) -> pa.Table:
        """Links among the documents of a tree that join its components."""
        sets = list(sets_in(x.as_py() for x in table["blob"]))
        vectors, n = [count_vector(x) for x in sets], np.array(list(map(len, sets)))
        comp, doc, part = (table[c].to_numpy() for c in ("comp", "doc", "part"))
        edges, _ = forest([np.zeros(1, np.uint64)] * len(sets), n, comp, vectors.__getitem__, percent, lambda i, j: linked(sets[i], sets[j], percent))
        i, j = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.table([pa.array(x) for x in (doc[i], part[i], doc[j], part[j])], PAIR.names)

    ends = lambda rows: rows.select(node("doc", "part").alias("a"), node("doc2", "part2").alias("b"))
    edges_of = lambda labels: labels.select(F.col("v").alias("a"), F.col("label").alias("b"))
    own = marks.select("doc", "part").distinct().select("doc", "part", F.col("doc").alias("doc2"), F.col("part").alias("part2"))
    asked = pairs.unionByName(own).mapInArrow(ask, f"q int, role int, {pair_schema}")
    late = settle(asked.groupBy("q").cogroup(texts.groupBy("d")).applyInArrow(answer, sent_schema).groupBy("g").applyInArrow(check_pairs, sent_schema))
    labels = components(edges_of(early).unionByName(ends(late.filter("role = 3"))))
    placed = marks.join(labels, node("doc", "part") == F.col("v"), "left").select("doc", "part", "g", "tree", component.alias("comp"))
    torn = settle(placed.groupBy("g", "tree").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("g", "tree"))
    if torn.limit(1).count():
        placed = placed.join(torn, ["g", "tree"]).withColumn("comp", F.xxhash64("comp") if apart else F.col("comp"))
        placed = placed.join(late.filter("role = 5").select("doc", "part", "blob"), ["doc", "part"])
        labels = components(edges_of(labels).unionByName(ends(placed.groupBy("g", "tree").applyInArrow(settle_tree, pair_schema))))
    result = sizes.join(labels, node("doc", "part") == labels["v"], "left")
    if apart:
        return result.select("doc", "part", component.alias("first"))
    hidden = lambda c: F.when(c != int(NONE), c)
    return result.select(hidden(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), hidden(F.coalesce("label", "doc")).alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents without those that link to a smaller doc_id's component; one of each group stays."""
    linked_docs = settle(link(docs, **how).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(linked_docs, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")


def keep_one_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """As keep_one, but rows that share a doc_id (or have none) stay or go by their own texts; of rows with one id and text one stays, if the text is not blank."""
    if not share_ids(docs.select(id_col)):
        return keep_one(docs, id_col=id_col, text_col=text_col, **how)
    doc, part = (f"__{c}" + "_" * max(map(len, docs.columns)) for c in ("doc", "part"))  # names that no column has
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = link(docs, id_col=id_col, text_col=text_col, apart=True, **how)
    gone = settle(rows.filter(F.struct("doc", "part") != F.col("first")).select(F.col("doc").alias(doc), F.col("part").alias(part)).distinct())
    kept = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(NONE)))).withColumn(part, F.xxhash64(text)).join(gone, [doc, part], "left_anti")
    written = text.rlike(r"[^\x20\x09-\x0D]")
    return kept.filter(~written).unionByName(kept.filter(written).dropDuplicates([doc, part])).select(*(f"`{c}`" for c in docs.columns))
