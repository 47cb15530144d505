"""Plug-in points: callables that take a DataFrame and give one, or None to decline.

Points are "synthesis", "streaming", "intro" (answers), "aliases", "concepts" (side tables: installed as DataFrames) and "layout" (which shapes leave a board).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

Backend = Callable[[DataFrame], DataFrame | None]
POINTS = ("synthesis", "streaming", "intro", "aliases", "concepts", "layout")
_installed: dict[str, Backend] = {}


def install(point: str, backend: Backend | DataFrame | None) -> None:
    """Puts a backend (or, for side tables, a DataFrame) at a point; None takes it away."""
    if point not in POINTS:
        raise ValueError(f"no such point: {point}")
    if backend is None:
        _installed.pop(point, None)
    else:
        _installed[point] = backend if callable(backend) and not isinstance(backend, DataFrame) else lambda _: backend


@contextmanager
def installed(point: str, backend: Backend | DataFrame) -> Iterator[None]:
    before = _installed.get(point)
    install(point, backend)
    try:
        yield
    finally:
        install(point, before)


def call(point: str, rows: DataFrame, default: Backend) -> DataFrame:
    """What the installed backend makes of the rows; the default's answer if there is none or it declines."""
    got = _installed[point](rows) if point in _installed else None
    return default(rows) if got is None else got
