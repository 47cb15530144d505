"""Packing documents into training windows by order-preserving dynamic programming.

Documents are dealt to streams by a hash of id and text, about ``STREAM_ROWS`` to a stream, and a
stream takes them in order of id (then text), so the result follows from the rows alone and
not from the partitions they lie in.  Window
cuts are chosen among document ends, sentence ends and, in sentences longer than
``FREE_EVERY`` tokens, points inside; each kind has a penalty in tokens.  With places
p_0 < p_1 < ..., the least cost of a stream that ends at p_j is

    c_j = penalty_j + min over i with p_j - p_i <= size of (c_i + size - (p_j - p_i)),

and since the minimum is over c_i + p_i in a sliding range, a monotone queue finds each
in constant time: linear in the number of places.  Streams are planned ``SEGMENT`` tokens at
a time; the last, open window of a segment is carried into the next.  The open windows that
streams end with are streams of their own, ``FAN`` to one, planned in the same way; what they leave
is planned again, until one stream is left.  Only what the very last window of all holds (less than ``size`` tokens in the whole corpus)
is cut at powers of two, the lengths that need no padding; all others are cuts of the programme.

Texts are shuffled once, tokenized once, and memory is one segment whatever the stream's size.
The pieces (some 60 bytes each, with their ids if these are asked for) are checkpointed, so that the open windows can be
gathered without tokenizing twice; a lost task is repeated with the same result.

Defined cases: null text is empty and has the end token alone; a text longer than a window
spans several; repeated rows are packed as often as they occur (rows with the same id and text lie in one stream);
a null doc_id comes first in its stream; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .external import release
from .tokens import encoder, vocabulary

SEGMENT = 1 << 20
#: Documents to a stream, on average, and open windows to a stream of such.
STREAM_ROWS, FAN = 4096, 256
#: Penalties, in tokens, of a cut at a sentence's end and inside a sentence; FREE_EVERY: tokens between places inside a sentence.
AT_SENTENCE, INSIDE, FREE_EVERY = 8, 64, 128
#: Of the sentence ends within a stretch of so many tokens the last is a place.
APART = 16


def plan(places: np.ndarray, penalties: np.ndarray, size: int, closed: bool) -> list[int]:
    """Indices into places (ascending, no gap over size, the first is 0) of the best cuts.

    closed: the stream ends at the last place; else the cheapest last cut that leaves less than a window.
    """
    at, fee = places.tolist(), penalties.tolist()
    n = len(at)
    cost, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    key = [0] * n
    for j in range(1, n):
        p = at[j]
        while at[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost[j] = c = fee[j] + size - p + key[i]
        key[j] = k = c + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    if closed:
        j = n - 1
    else:
        j = min((x for x in range(n - 1, -1, -1) if at[x] > at[-1] - size), key=cost.__getitem__, default=n - 1)
    cuts = []
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def powers(n: int) -> list[int]:
    """Falling powers of two that add up to n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    sentence = np.flatnonzero(ends_sentence[ids]) + 1
    sentence = sentence[np.diff(sentence // APART, append=-1) != 0]
    known = np.union1d(np.union1d(sentence, doc_ends), [0])
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > min(FREE_EVERY, size))
    step = min(FREE_EVERY, size)
    inside = np.concatenate([np.arange(known[i] + step, known[i + 1], step) for i in wide]) if len(wide) else np.empty(0, np.int64)
    places = np.union1d(known, inside).astype(np.int64)
    fees = np.full(len(places), INSIDE, np.int64)
    fees[np.searchsorted(places, known)] = AT_SENTENCE
    fees[np.searchsorted(places, doc_ends)] = 0
    return places, fees


class Packer:
    """Takes documents one by one; gives pieces (document number, start, length, crc, tokens, sequence, offset, ids)."""

    def __init__(self, size: int, ends_sentence: np.ndarray):
        self.size, self.ends_sentence = size, ends_sentence
        self.open: list[list] = []  # [document, ids, offset of these ids in it, tokens of the document]
        self.held = self.sequence = 0

    def add(self, doc, ids: np.ndarray, start: int, total: int):
        """Takes the ids of a document, or what is left of them from start on."""
        self.open.append([doc, ids, start, total])
        self.held += len(ids)
        if self.held >= SEGMENT:
            yield from self.cut(False)

    def cut(self, closed: bool):
        if not self.open:
            return
        ids = np.concatenate([x[1] for x in self.open])
        ends = np.cumsum([len(x[1]) for x in self.open])
        places, fees = cut_places(ids, ends, self.ends_sentence, self.size)
        bounds = [0, *(int(places[j]) for j in plan(places, fees, self.size, False))]
        if closed:
            for n in powers(len(ids) - bounds[-1]):
                bounds.append(bounds[-1] + n)
        raw = ids.tobytes()
        k, before = 0, 0  # the document that is being cut, and where it starts
        for first, last in zip(bounds, bounds[1:], strict=False):
            at = first
            while at < last:
                doc, own, skipped, total = self.open[k]
                stop = min(last, before + len(own))
                part = raw[4 * at : 4 * stop]
                yield doc, skipped + at - before, stop - at, zlib.crc32(part), total, self.sequence, at - first, part
                if stop == before + len(own):
                    before, k = stop, k + 1
                at = stop
            self.sequence += 1
        rest = bounds[-1]
        kept = self.open[k:]
        if kept and rest > before:
            doc, own, skipped, total = kept[0]
            kept[0] = [doc, own[rest - before :], skipped + rest - before, total]
        self.open, self.held = kept, len(ids) - rest


def sentence_ends(path: str) -> np.ndarray:
    """By id: whether a token is made of signs of which the last ends a sentence."""
    vocab = encoder(path).whole.get_vocab()
    table = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        bare = token.removesuffix("</w>")
        table[i] = token.endswith("</w>") and bare[-1:] in (".", "!", "?") and not any(c.isalnum() for c in bare)
    return table


def pack(docs: DataFrame, size: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, the piece's own, if with_ids)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    streams = -(-rows.count() // STREAM_ROWS) or 1
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, rest binary, stream bigint" + ", ids array<int>" * with_ids

    def planned(level: int, closed: bool):
        """Plans each stream; its pieces, then (with the stream's number) what its open window holds."""

        def run(batches):
            path = vocabulary(tokenizer)
            code, ends, end, doc_type = encoder(path), sentence_ends(path), np.array([end_id], "<u4").tobytes(), None
            packer, at, out = None, None, []

            def table():
                columns = list(zip(*out, strict=True))
                out.clear()
                arrays = [pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.binary()), pa.array(columns[8], pa.int64())]
                if with_ids:
                    arrays.append(pa.array([None if x is None else np.frombuffer(x, "<u4").astype(np.int32) for x in columns[9]], pa.list_(pa.int32())))
                return pa.RecordBatch.from_arrays(arrays, [*names, "rest", "stream", "ids"][: len(arrays)])

            def put(pieces):
                base = level << 58 | at << 32
                for doc, start, length, crc, total, sequence, offset, ids in pieces:
                    out.append((doc, start, length, crc, total, base + sequence, offset, None, None, ids))

            def finish():
                put(packer.cut(closed))
                for k, (doc, ids, start, total) in enumerate(packer.open):
                    out.append((doc, start, len(ids), None, total, None, k, ids.tobytes(), at, None))

            for batch in batches:
                doc_type = batch.schema.field(1).type
                rest = [c.to_pylist() for c in batch.columns[3:]]
                for i, (stream, doc, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                    if stream != at:
                        if packer:
                            finish()
                        packer, at = Packer(size, ends), stream
                    ids = np.frombuffer(text if level else code.encode(text or "") + end, "<u4")
                    put(packer.add(doc, ids, *((rest[0][i], rest[1][i]) if level else (0, len(ids)))))
                    if len(out) >= 10_000:
                        yield table()
            if packer:
                finish()
            if out:
                yield table()
            code.forget()
            release()

        return run

    stream = F.pmod(F.xxhash64("doc_id", "text"), F.lit(streams)).alias("stream")
    dealt = rows.select(stream, "doc_id", "text").repartition("stream").sortWithinPartitions("stream", "doc_id", "text")
    made = settle(dealt.mapInArrow(planned(0, False), schema))
    parts, level = [made.filter("stream IS NULL")], 0
    while True:  # each round leaves a FAN-th of the streams
        left = made.filter("stream IS NOT NULL").select((F.col("stream") / FAN).cast("bigint").alias("to"), "doc_id", "rest", "start", "doc_tokens", "stream", "offset")
        streams, level = -(-streams // FAN), level + 1
        made = left.repartition("to").sortWithinPartitions("to", "stream", "offset").mapInArrow(planned(level, streams == 1), schema)
        if streams > 1:
            made = settle(made)
        parts.append(made.filter("stream IS NULL"))
        if streams == 1:
            break
    return reduce(DataFrame.unionByName, parts).select(*names, *["ids"] * with_ids)
