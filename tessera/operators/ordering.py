"""Orders and clusters of graphs that belong to a key: each graph is one document's or one scene's, and is worked on as a whole."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import settle


def longest_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """g, nid, level: the longest path from a source, by relaxation over all graphs at once (one join a round); a cycle that is reached raises ValueError."""
    levels = settle(nodes.select("g", "nid", F.lit(0).alias("level")))
    most = nodes.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most):  # a path of an acyclic graph has fewer edges than its graph has nodes
        raised = edges.join(levels, (edges["g"] == levels["g"]) & (edges["src"] == levels["nid"])).groupBy(edges["g"].alias("eg"), F.col("dst").alias("en")).agg((F.max("level") + 1).alias("up"))
        joined = levels.join(raised, (F.col("g") == F.col("eg")) & (F.col("nid") == F.col("en")), "left")
        new = settle(joined.select("g", "nid", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), (F.coalesce("up", F.lit(0)) > F.col("level")).alias("moved")))
        levels = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return levels
    if most:
        raise ValueError(f"a graph has a cycle: levels still rise after {most} rounds")
    return levels


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(g, nid, page), edges(g, src, dst) -> g, nid, place: Kahn's order, ties by page, then nid; a cycle is broken at its first node."""

    def run(key, ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        page = dict(zip(ns["nid"], ns["page"], strict=True))
        after: dict[str, set] = {n: set() for n in page}
        waits = dict.fromkeys(page, 0)
        for a, b in set(zip(es["src"], es["dst"], strict=True)):
            if a in page and b in page and a != b:
                after[a].add(b)
                waits[b] += 1
        ready = [(page[n], n) for n in page if not waits[n]]
        heapq.heapify(ready)
        left, out = dict.fromkeys(sorted(page, key=lambda n: (page[n], n))), []
        while left:
            if not ready:
                n = next(iter(left))
                ready = [(page[n], n)]
            _, n = heapq.heappop(ready)
            if n not in left:
                continue
            del left[n]
            out.append(n)
            for m in after[n]:
                waits[m] -= 1
                if waits[m] == 0 and m in left:
                    heapq.heappush(ready, (page[m], m))
        return pd.DataFrame({"g": [key[0]] * len(out), "nid": out, "place": range(len(out))})

    kind = nodes.schema["g"].dataType.simpleString()
    return nodes.groupBy("g").cogroup(edges.groupBy("g")).applyInPandas(run, f"g {kind}, nid string, place bigint")


def greedy_clusters(items: DataFrame, threshold: float = 0.92) -> DataFrame:
    """items(g, phrase, n, vec) -> g, phrase, cluster: in order of falling n, each phrase joins the nearest centroid within the threshold, or founds a cluster."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "phrase"], ascending=[False, True])
        sums: list[np.ndarray] = []
        out = []
        for v in pdf["vec"]:
            x = np.asarray(v, float)
            x = x / (np.linalg.norm(x) or 1.0)
            best = max(range(len(sums)), key=lambda i: float(x @ sums[i]) / (np.linalg.norm(sums[i]) or 1.0), default=-1)
            if best >= 0 and float(x @ sums[best]) / (np.linalg.norm(sums[best]) or 1.0) >= threshold:
                sums[best] = sums[best] + x
            else:
                best = len(sums)
                sums.append(x)
            out.append(best)
        return pd.DataFrame({"g": pdf["g"], "phrase": pdf["phrase"], "cluster": out})

    return items.groupBy("g").applyInPandas(run, f"g {items.schema['g'].dataType.simpleString()}, phrase string, cluster bigint")


def spans_by_priority(spans: DataFrame) -> DataFrame:
    """spans(doc, start, end, priority): those that overlap none taken before, by priority, then start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int]] = []
        rows = []
        for r in pdf.sort_values(["priority", "start", "end"]).itertuples(index=False):
            if all(r.end <= a or r.start >= b for a, b in taken):
                taken.append((r.start, r.end))
                rows.append(r)
        return pd.DataFrame(rows, columns=pdf.columns)

    return spans.groupBy("doc").applyInPandas(run, spans.schema)
