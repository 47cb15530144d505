"""Packed rows that are dealt to groups, and sorting that spills to disk.

Rows travel between tasks as compressed blobs of structured arrays, one per task and group, so a
shuffle moves columns instead of single rows and a group is decoded by numpy.
"""

from __future__ import annotations

import ctypes
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

_random = np.random.default_rng(20_240_229)
BYTE = _random.integers(0, 2**64, 256, np.uint64)
ODD = _random.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
#: Stands for a null doc_id.
NONE = np.int64(-(2**63))
#: Rows of a sorted run in memory.
RUN = 1 << 21


def release() -> None:
    """Gives free memory back to the system: a worker lives on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * ODD[14]
    h ^= h >> np.uint64(29)
    h *= ODD[15]
    return h ^ (h >> np.uint64(32))


def squeeze(rows: np.ndarray, level: int = 1) -> bytes:
    """A structured array, column by column, integers but hashes as differences."""
    parts = []
    for name in rows.dtype.names:
        c = np.ascontiguousarray(rows[name])
        parts.append((c if name == "hash" or c.ndim > 1 or c.dtype.kind != "i" else np.diff(c, prepend=c.dtype.type(0))).tobytes())
    return zstandard.compress(b"".join(parts), level)


def expand(blob: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.decompress(blob)
    n, at = len(raw) // kind.itemsize, 0
    rows = np.empty(n, kind)
    for name in kind.names:
        base, shape = (kind[name].subdtype or (kind[name], ()))[:2]
        count = n * int(np.prod(shape, dtype=np.int64))
        c = np.frombuffer(raw, base, count, at).reshape(n, *shape)
        at += count * base.itemsize
        rows[name] = c if name == "hash" or shape or base.kind != "i" else np.cumsum(c, dtype=base)
    return rows


def doc_group(doc: np.ndarray, part: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64) * ODD[12] + part.astype(np.uint64)) % np.uint64(groups)).astype(np.int32)


def dealt(group: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(group, blob) of the rows of each group, their order kept."""
    order = np.argsort(group, kind="stable")
    group, rows = group[order], rows[order]
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(rows)], strict=False):
        yield int(group[lo]), squeeze(rows[lo:hi])


def record(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], ["g", "blob"])


class Sorter:
    """Sorts structured rows by hash, then the other keys, in runs; full runs go to disk and are merged through a priority queue."""

    def __init__(self, kind: np.dtype, run: int = RUN, keys: tuple[str, ...] = ("doc", "part", "pos")):
        self.kind, self.run, self.rows, self.held, self.keys = kind, run, [], 0, keys
        self.file, self.runs = None, []

    def order(self, rows: np.ndarray) -> np.ndarray:
        return rows[np.lexsort((*(rows[k] for k in reversed(self.keys)), rows["hash"]))]

    def add(self, rows: np.ndarray) -> None:
        self.rows.append(rows)
        self.held += len(rows)
        if self.held >= self.run:
            self._spill()

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.rows) if self.rows else np.empty(0, self.kind)
        self.rows, self.held = [], 0
        return self.order(rows)

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        rows = self._sorted()
        self.runs.append([self.file.tell(), len(rows)])
        self.file.write(rows.tobytes())

    def blocks(self, block: int = 1 << 17) -> Iterator[np.ndarray]:
        """The rows in order; a hash is never split over two blocks."""
        if not self.runs:
            if len(rows := self._sorted()):
                yield rows
            return
        if self.rows:
            self._spill()
        queue: list[tuple[int, int]] = []  # (last hash in memory, run) of the runs that have more on disk
        loaded = [np.empty(0, self.kind) for _ in self.runs]

        def load(i: int) -> None:
            at, n = self.runs[i]
            take = min(block, n)
            self.file.seek(at)
            loaded[i] = np.concatenate([loaded[i], np.frombuffer(self.file.read(take * self.kind.itemsize), self.kind)])
            self.runs[i] = [at + take * self.kind.itemsize, n - take]
            if n > take:
                heapq.heappush(queue, (int(loaded[i]["hash"][-1]), i))

        def ready(limit: int | None) -> np.ndarray:
            """Takes the rows below the limit out of memory, in order."""
            found = []
            for i, rows in enumerate(loaded):
                n = len(rows) if limit is None else int(np.searchsorted(rows["hash"], np.uint64(limit)))
                found.append(rows[:n])
                loaded[i] = rows[n:]
            rows = np.concatenate(found)
            return self.order(rows)

        for i in range(len(self.runs)):
            load(i)
        while queue:
            limit, i = heapq.heappop(queue)  # below it, all rows of all runs are in memory
            rows = ready(limit)
            load(i)
            if len(rows):
                yield rows
        if len(rows := ready(None)):
            yield rows
