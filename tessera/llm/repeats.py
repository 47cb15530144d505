"""Removal of repeated byte strings by external sorting of sampled suffixes and induction.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a
smaller doc_id, or earlier in the document).  Sorting every suffix of a corpus is more work
than the result needs, so, as in induced sorting, only a subset of suffixes is sorted and
the rest follows from it:

1. Of every ``length`` bytes the suffix whose first ``GRAM`` bytes hash lowest is sampled (about
   one suffix in 35 bytes).  The choice depends on those bytes alone, so equal strings
   sample equal places: each repeat shows as equal sampled suffixes at equal offsets.
2. Tuples (hash, doc, position) are dealt by hash and sorted, in runs that spill to disk
   and come back through a priority queue, so a shard may be far larger than memory.
   Suffixes met once are done with.
3. The others fetch the bytes around them.  Tuples are sorted again, and the
   common-prefix (and -suffix) relation of equal ones is induced for all of the up to
   ``length - GRAM + 1`` strings that hold the sampled place: a string that an earlier tuple also has
   marks its bytes.
4. Each document unites its marks.

Full recursive suffix sorting with longest-common-prefix values is not carried out; the
README says why.  The result is the same, as strings are compared whole (by a 64-bit hash
of the string joined to the 64-bit hash of the sampled place).

Every step is linear in its input; what is shuffled is about 12 bytes per sampled
suffix, the compressed texts twice, and the surroundings of repeated suffixes.  Equal
surroundings are resolved where they are first met, before they are shuffled, so very common passages
shrink map-side.

Defined cases: null text is empty; texts under ``length`` bytes keep everything; a null doc_id
counts as the smallest; rows that share a doc_id and text are one document read
several times: neither repeats the other and all get the same result; rows that share a
doc_id only are ordered by a hash of their texts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .external import BYTE, NONE, ODD, RUN, Sorter, dealt, doc_group, expand, mix, record

GRAM = 32
#: Bytes of text that one array operation takes at once.
CHUNK = 1 << 21
#: Bytes of text for each group of suffixes and of documents, on average.
GROUPBYTES = 8 << 20

SUFFIX = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("part", "<i8"), ("pos", "<i8")])


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the size-byte strings from each place, by doubling (size a power of two)."""
    h = BYTE[data]
    step, k = 1, 0
    while step < size:
        h = h[:-step] * ODD[k] + h[step:]
        step, k = 2 * step, k + 1
    return mix(h)


def sampled(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the sampled suffixes of one document, in order."""
    width = length - GRAM + 1
    places, hashes = [], []
    last = -1
    for at in range(0, max(1, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        if len(part) < length:
            break
        h = gram_hashes(part, GRAM)
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # of equal ones the first is the least
        step = 1
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if width > step:
            low = np.minimum(low[: -(width - step)], low[width - step :])
        own = low & np.uint64(0xFFFFFFFF)
        own = own[np.flatnonzero(np.diff(own, prepend=np.uint64(2**40)))].astype(np.int64)
        place = own + at
        fresh = place > last
        places.append(place[fresh])
        hashes.append(h[own[fresh]])
        if len(place):
            last = max(last, int(place[-1]))
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.empty(0, np.int64), np.empty(0, np.uint64))


def around(kind_width: int) -> np.dtype:
    """A suffix with the bytes on both sides of its gram; left and right: how many of them its document has."""
    return np.dtype([*SUFFIX.descr, ("left", "u1"), ("right", "u1"), ("bytes", "u1", (kind_width,))])


MARK = np.dtype([("doc", "<i8"), ("part", "<i8"), ("start", "<i8"), ("end", "<i8")])


def first_and_repeats(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (sorted by hash, doc, part, pos) with equal hash and surroundings: the first ones, and the others."""
    if len(rows) < 2:
        return rows, rows[:0]
    view = np.ascontiguousarray(rows["bytes"])
    key = np.zeros(len(rows), np.uint64)
    wide = np.pad(view, ((0, 0), (0, -view.shape[1] % 8))).view("<u8")
    for j in range(wide.shape[1]):
        key = (key + wide[:, j]) * ODD[11]
        key ^= key >> np.uint64(32)
    key = mix(key * ODD[10] + rows["hash"] + rows["left"].astype(np.uint64) * ODD[9] + rows["right"].astype(np.uint64) * ODD[8])
    _, first = np.unique(key, return_index=True)
    is_first = np.zeros(len(rows), bool)
    is_first[first] = True
    return rows[is_first], rows[~is_first]


def whole_marks(rows: np.ndarray, side: int) -> np.ndarray:
    """Marks of suffixes all of whose strings an earlier one has."""
    rows = rows[rows["left"].astype(int) + rows["right"] >= side]
    out = np.empty(len(rows), MARK)
    out["doc"], out["part"] = rows["doc"], rows["part"]
    out["start"], out["end"] = rows["pos"] - rows["left"], rows["pos"] + GRAM + rows["right"]
    return out


def induced_marks(rows: np.ndarray, side: int, length: int) -> np.ndarray:
    """Marks of the strings around the sampled place that an earlier row with the same hash has, too."""
    group = np.cumsum(np.diff(rows["hash"], prepend=rows["hash"][:1]) != 0)
    rows = rows[np.bincount(group)[group] > 1] if len(rows) else rows
    out = []
    hi = 0
    while hi < len(rows):  # whole groups of about so many rows
        lo, last = hi, min(hi + (1 << 16), len(rows)) - 1
        hi = int(np.searchsorted(rows["hash"], rows["hash"][last], side="right"))
        part = rows[lo:hi]
        n = len(part)
        prefix = np.zeros((n, 2 * side + GRAM + 1), np.uint64)
        c = BYTE[part["bytes"]]
        for i in range(c.shape[1]):
            prefix[:, i + 1] = prefix[:, i] * ODD[13] + c[:, i]
        power = np.uint64(pow(int(ODD[13]), length, 2**64))
        low, high = np.full(n, 2**30), np.full(n, -1)
        for s in range(side + 1):
            able = np.flatnonzero((part["left"] >= side - s) & (part["right"].astype(int) >= s))
            key = mix((prefix[able, s + length] - prefix[able, s] * power) + part["hash"][able] * ODD[7])
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            later = able[first[back] != np.arange(len(able))]
            low[later] = np.minimum(low[later], s)
            high[later] = s
        hit = high >= 0
        m = np.empty(int(hit.sum()), MARK)
        m["doc"], m["part"] = part["doc"][hit], part["part"][hit]
        m["start"] = part["pos"][hit] - side + low[hit]
        m["end"] = part["pos"][hit] - side + high[hit] + length
        out.append(m)
    return np.concatenate(out) if out else np.empty(0, MARK)


def united(marks: np.ndarray) -> np.ndarray:
    """Marks of one document as separate runs (touching ones are one)."""
    marks = marks[np.argsort(marks["start"], kind="stable")]
    ends = np.maximum.accumulate(marks["end"])
    new = np.flatnonzero(np.concatenate([[True], marks["start"][1:] > ends[:-1]]))
    out = marks[new].copy()
    out["end"] = np.concatenate([ends[new[1:] - 1], ends[-1:]])
    return out


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUPBYTES, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (and kept, its remaining bytes, if with_bytes)."""
    if length < GRAM + 1:
        raise ValueError(f"length must exceed {GRAM}")
    side = length - GRAM
    wide = around(2 * side + GRAM)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    groups = max(64, -(-total // group_bytes))
    shared = source.groupBy("doc").count().filter("count > 1").limit(1).count() > 0
    source = source.select(F.coalesce("doc", F.lit(int(NONE))).alias("doc"), (F.xxhash64("text") if shared else F.lit(0).cast("bigint")).alias("part"), "text")

    def sample(batches):
        held, size = [], 0

        def flush():
            rows = np.concatenate(held)
            order = np.lexsort((rows["pos"], rows["part"], rows["doc"]))
            rows = rows[order]
            return record(list(dealt((rows["hash"] % np.uint64(groups)).astype(np.int32), rows)))

        for batch in batches:
            for doc, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.as_buffer().size else np.empty(0, np.uint8)
                if len(data) < length:
                    continue
                pos, hashes = sampled(data, length)
                rows = np.empty(len(pos), SUFFIX)
                rows["hash"], rows["doc"], rows["part"], rows["pos"] = hashes, doc, part, pos
                held.append(rows)
                size += len(rows)
                if size >= RUN // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def repeated(table: pa.Table) -> pa.Table:
        sorter = Sorter(SUFFIX)
        for blob in table["blob"]:
            sorter.add(expand(blob.as_py(), SUFFIX))
        pairs = []
        for rows in sorter.blocks():
            same = np.concatenate([[True], np.any([rows[c][1:] != rows[c][:-1] for c in SUFFIX.names], axis=0)])
            rows = rows[same]  # a document that was read twice counts once
            new = np.diff(rows["hash"], prepend=rows["hash"][:1] ^ np.uint64(1)) != 0
            group = np.cumsum(new) - 1
            rows = rows[np.bincount(group)[group] > 1]
            rows = rows[np.lexsort((rows["pos"], rows["part"], rows["doc"]))]
            pairs += list(dealt(doc_group(rows["doc"], rows["part"], groups), rows))
        return pa.Table.from_batches([record(pairs)])

    def compress(batches):
        for batch in batches:
            doc, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            blobs = [zstandard.compress(x.as_buffer() if x.as_buffer().size else b"", 1) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_group(doc, part, groups), pa.int32()), batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["d", "doc", "part", "z"])

    def texts_of(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        for doc, part, z in zip(table["doc"].to_pylist(), table["part"].to_pylist(), table["z"], strict=True):
            yield doc, part, zstandard.decompress(z.as_py())

    def by_document(rows: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        rows = rows[np.lexsort((rows["part"], rows["doc"]))]
        cuts = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["part"][1:] != rows["part"][:-1])])) if len(rows) else []
        return {(int(rows["doc"][a]), int(rows["part"][a])): rows[a:b] for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)}

    def fetch(key, suffixes: pa.Table, texts: pa.Table) -> pa.Table:
        """The surroundings of repeated suffixes, dealt by hash; equal ones within this group are marked at once (group -1)."""
        if not suffixes.num_rows:
            return pa.Table.from_batches([record([])])
        wanted = by_document(np.concatenate([expand(b.as_py(), SUFFIX) for b in suffixes["blob"]]))
        found = []
        for doc, part, raw in texts_of(texts):
            own = wanted.pop((doc, part), None)
            if own is None:
                continue
            data = np.zeros(len(raw) + 2 * side, np.uint8)
            data[side : side + len(raw)] = np.frombuffer(raw, np.uint8)
            rows = np.empty(len(own), wide)
            for c in SUFFIX.names:
                rows[c] = own[c]
            rows["left"], rows["right"] = np.minimum(side, own["pos"]), np.minimum(side, len(raw) - GRAM - own["pos"])
            rows["bytes"] = data[own["pos"][:, None] + np.arange(2 * side + GRAM)]
            found.append(rows)
        if not found:
            return pa.Table.from_batches([record([])])
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows["pos"], rows["part"], rows["doc"], rows["hash"]))]
        first, others = first_and_repeats(rows)
        marks = whole_marks(others, side)
        pairs = list(dealt((first["hash"] % np.uint64(groups)).astype(np.int32), first))
        if len(marks):
            pairs += [(-1 - g, b) for g, b in dealt(doc_group(marks["doc"], marks["part"], groups), marks)]
        return pa.Table.from_batches([record(pairs)])

    def induce(table: pa.Table) -> pa.Table:
        g = table["g"][0].as_py()
        if g < 0:  # marks that were found on the way
            return pa.table({"g": pa.array([-1 - g] * table.num_rows, pa.int32()), "blob": table["blob"]})
        sorter = Sorter(wide, RUN // 8)
        for blob in table["blob"]:
            sorter.add(expand(blob.as_py(), wide))
        pairs = []
        for rows in sorter.blocks(1 << 14):
            first, others = first_and_repeats(rows)
            marks = np.concatenate([whole_marks(others, side), induced_marks(first, side, length)])
            pairs += list(dealt(doc_group(marks["doc"], marks["part"], groups), marks))
        return pa.Table.from_batches([record(pairs)])

    kept_field = ", kept binary" if with_bytes else ""

    def finish(key, marks: pa.Table, texts: pa.Table) -> pa.Table:
        own = by_document(np.concatenate([expand(b.as_py(), MARK) for b in marks["blob"]])) if marks.num_rows else {}
        out = []
        for doc, part, raw in texts_of(texts):
            got, spans = own.get((doc, part)), ()
            kept = raw
            if got is not None:
                spans = united(got)
                edges = [0, *(int(x) for s in spans for x in (s["start"], s["end"])), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((None if doc == NONE else doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept] if with_bytes else [])))
        columns = list(zip(*out, strict=True)) if out else [[]] * (5 + with_bytes)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], columns, kinds, strict=False)})

    blobs = "g int, blob binary"
    texts = source.mapInArrow(compress, "d int, doc bigint, part bigint, z binary")
    suffixes = source.mapInArrow(sample, blobs).groupBy("g").applyInArrow(repeated, blobs)
    met = suffixes.groupBy("g").cogroup(texts.groupBy("d")).applyInArrow(fetch, blobs)
    marks = met.groupBy("g").applyInArrow(induce, blobs)
    return marks.groupBy("g").cogroup(texts.groupBy("d")).applyInArrow(finish, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{kept_field}")
