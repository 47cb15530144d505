"""Boxes: overlaps, colliders, group boxes and treemaps. boxes(scene, nid, x, y, w, h)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(boxes: DataFrame, size: float) -> DataFrame:
    lo = lambda c: F.floor(F.col(c) / size)
    hi = lambda c, d: F.floor((F.col(c) + F.col(d)) / size)
    return boxes.withColumn("gx", F.explode(F.sequence(lo("x"), hi("x", "w")))).withColumn("gy", F.explode(F.sequence(lo("y"), hi("y", "h"))))


def overlaps(boxes: DataFrame, cell: float, gap: float = 0.0, drop_contained: bool = True) -> DataFrame:
    """scene, a, b: boxes of a scene that intersect (or come nearer than gap), a < b.

    Boxes meet in grid cells, an equi-join; each pair counts in the cell that holds the top left corner of its intersection, so none comes twice.
    """
    grown = boxes.select("scene", "nid", *[(F.col(c) - gap / 2).alias(c) for c in ("x", "y")], *[(F.col(c) + gap).alias(c) for c in ("w", "h")])
    g = _cells(grown, cell)
    a, b = g.alias("a"), g.alias("b")
    rows = a.join(b, (F.col("a.scene") == F.col("b.scene")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy"))).filter("a.nid < b.nid")
    rows = rows.filter("a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
    rows = rows.filter((F.floor(F.greatest("a.x", "b.x") / cell) == F.col("a.gx")) & (F.floor(F.greatest("a.y", "b.y") / cell) == F.col("a.gy")))
    if drop_contained:
        holds = lambda p, q: f"({p}.x <= {q}.x AND {p}.y <= {q}.y AND {p}.x + {p}.w >= {q}.x + {q}.w AND {p}.y + {p}.h >= {q}.y + {q}.h)"
        rows = rows.filter(f"NOT {holds('a', 'b')} AND NOT {holds('b', 'a')}")
    return rows.select(F.col("a.scene").alias("scene"), F.col("a.nid").alias("a"), F.col("b.nid").alias("b"))


def colliders(boxes: DataFrame, probes: DataFrame, cell: float) -> DataFrame:
    """probes(scene, pid, x, y, w, h): boxes that each probe would touch."""
    p = _cells(probes.withColumnRenamed("pid", "nid"), cell).alias("p")
    b = _cells(boxes, cell).alias("b")
    rows = p.join(b, (F.col("p.scene") == F.col("b.scene")) & (F.col("p.gx") == F.col("b.gx")) & (F.col("p.gy") == F.col("b.gy")))
    rows = rows.filter("p.x < b.x + b.w AND b.x < p.x + p.w AND p.y < b.y + b.h AND b.y < p.y + p.h")
    return rows.select(F.col("p.scene").alias("scene"), F.col("p.nid").alias("pid"), F.col("b.nid").alias("nid")).distinct()


def group_boxes(boxes: DataFrame, parents: DataFrame) -> DataFrame:
    """scene, parent, x, y, w, h: the box around each parent's members; of several parents of a box the first counts."""
    first = parents.groupBy("scene", "nid").agg(F.min_by("parent", "seq").alias("parent"))
    rows = boxes.join(first, ["scene", "nid"]).groupBy("scene", "parent")
    rows = rows.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    return rows.select("scene", "parent", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))


def _worst(row: list[float], side: float) -> float:
    s = sum(row)
    return max(max(side * side * v / (s * s), s * s / (side * side * v)) for v in row)


def squarify(weights: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles for falling weights that fill a box with sides as even as can be (the squarified treemap)."""
    total = sum(weights)
    areas = [v * w * h / total for v in weights] if total > 0 else []
    out: list[tuple[float, float, float, float]] = []
    i = 0
    while i < len(areas):
        side, row = min(w, h), [areas[i]]
        while i + len(row) < len(areas) and _worst([*row, areas[i + len(row)]], side) <= _worst(row, side):
            row.append(areas[i + len(row)])
        thick = sum(row) / side if side else 0.0
        at = y if w >= h else x
        for v in row:
            length = v / thick if thick else 0.0
            out.append((x, at, thick, length) if w >= h else (at, y, length, thick))
            at += length
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        i += len(row)
    return out


def treemap(items: DataFrame, width: float = 100.0, height: float = 100.0) -> DataFrame:
    """items(parent, nid, weight) -> boxes within each parent's own width x height; weights of 0 or less get none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.weight > 0].sort_values(["weight", "nid"], ascending=[False, True])
        boxes = squarify(pdf.weight.tolist(), 0.0, 0.0, width, height)
        return pd.DataFrame([(p, n, *b) for p, n, b in zip(pdf.parent, pdf.nid, boxes, strict=True)], columns=["parent", "nid", "x", "y", "w", "h"])

    return items.groupBy("parent").applyInPandas(run, f"parent {items.schema['parent'].dataType.simpleString()}, nid {items.schema['nid'].dataType.simpleString()}, x double, y double, w double, h double")


def violations(groups: DataFrame, gap: float, cell: float) -> DataFrame:
    """scene, a, b, ox, oy: groups nearer to each other than the gap, and by how much they overlap (less than 0: the room between them)."""
    near = overlaps(groups, cell, gap, drop_contained=False)
    a, b = (groups.select("scene", F.col("nid").alias(s), *[F.col(c).alias(s + c) for c in "xywh"]) for s in "ab")
    span = lambda c, d: F.least(F.col(f"a{c}") + F.col(f"a{d}"), F.col(f"b{c}") + F.col(f"b{d}")) - F.greatest(f"a{c}", f"b{c}")
    return near.join(a, ["scene", "a"]).join(b, ["scene", "b"]).select("scene", "a", "b", span("x", "w").alias("ox"), span("y", "h").alias("oy"))
