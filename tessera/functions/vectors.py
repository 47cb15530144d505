"""Vector and rank functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The dot product of vectors of unit length (within 1e-3), else the cosine; 0 if empty, of differing length or zero."""
    na, nb, d = norm(a), norm(b), dot(a, b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    unit = (F.abs(na - 1) < 1e-3) & (F.abs(nb - 1) < 1e-3)
    return F.when(~usable, F.lit(0.0)).when(unit, d).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(d / (na * nb))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def reciprocal_rank(rank0: Column, k: int = 60) -> Column:
    """1 / (k + rank), rank from 0; nothing where there is no rank."""
    return F.coalesce(1.0 / (k + rank0), F.lit(0.0))


def proximity(template_nid: Column, focus_nid: Column) -> Column:
    """100 for each leading path segment in common, less the difference in depth."""
    a, b = F.split(template_nid, "/"), F.split(focus_nid, "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return 100 * common - F.abs(F.size(a) - F.size(b))
