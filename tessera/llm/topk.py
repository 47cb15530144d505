"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors become integers, floor(scale * x).  A rotation from the singular vectors of all
rows (their Gram matrix is summed in one aggregate of dimension x dimension numbers)
gathers most of a vector's length in its first coordinates.  Rows are dealt into blocks
by descending length.  Every query meets the block of the longest rows first, and its
k-th best score there is a threshold.  Against each other block it is dropped at once
when |q| * (longest of the block) is below the threshold; else partial sums over the first
coordinates, plus the Cauchy-Schwarz bound |q_rest| |v_rest| on the others, prune rows, and
only those left get their exact integer score.

The queries are themselves dealt into blocks, by the length that a row needs to reach their threshold, so a task holds one block of either kind
(``BLOCK_ROWS`` rows each), whatever their number.  A block of rows is copied only to the blocks of queries that
some row of its length may serve; only k rows per query and block are
shuffled.  Bounds carry a margin over the rounding of the rotation, so pruning never
costs a result; ties at the threshold are kept and go to the smaller vec_id.

Scores are exact at any size.  Products whose sums stay below 2**53 are taken in floating point, which is then exact; below 2**62
components are split in two halves and the three partial sums joined as integers; beyond that, rounded products with a
margin select the rows, and those are scored in whole numbers without limit.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part; vectors of differing length are taken to end in zeros; repeated rows count as rows
of their own (a query leaves out the rows with its own vec_id); a null vec_id takes no
part; fewer than k candidates give fewer rows; an empty table gives none; extra columns
are ignored.  A score that a long cannot hold is shown as the nearest long, and ranked by its true value.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

BLOCK_ROWS = 8192
#: Ranges of lengths, at most.
BANDS = 200
#: Share of the coordinates in the first partial sum.
LEAD = 0.25


def taking_part(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v (doubles), norm2 (of the scaled row, rounded) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), x.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    # a component's floor is at most one away from it
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + (F.abs(c) * float(scale) + 1) * (F.abs(c) * float(scale) + 1)))


def _array(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of lists as a matrix of dim columns, short ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), np.float64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, from their Gram matrix (dim x dim numbers reach the driver)."""

    def run(batches):
        gram = np.zeros((dim, dim))
        for b in batches:
            x = _array(b.column(0), dim)
            x = x[np.abs(x).max(1) < 1e100]  # any rotation serves the rest
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(gram), pa.list_(pa.float64()))], ["i", "row"])

    sums = F.array(*[F.sum(F.col("row")[j]) for j in range(dim)])
    got = rows.select("v").mapInArrow(run, "i int, row array<double>").groupBy("i").agg(sums.alias("row")).collect()
    gram = np.zeros((dim, dim))
    for r in got:
        gram[r["i"]] = r["row"]
    _, vectors = np.linalg.eigh(gram)
    return vectors[:, ::-1].copy()


def split_product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products of rows of whole numbers as int64, for sums below 2**62."""
    half = float(1 << 20)
    qh, vh = np.floor(q / half), np.floor(v / half)
    ql, vl = q - qh * half, v - vh * half
    cross = qh @ vl.T + ql @ vh.T
    return ((qh @ vh.T).astype(np.int64) << 40) + (cross.astype(np.int64) << 20) + (ql @ vl.T).astype(np.int64)


def best(qid, q, vid, v, r, k, floor, lead):
    """Rows (query, vec_id, score) of whole-number vectors: each query's k best in the block with score >= its floor."""
    dim = q.shape[1]
    plain = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * dim < 2.0**53
    qr, vr = q @ r, v @ r
    q_rest, v_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(vr[:, lead:], axis=1)
    v_norm = np.linalg.norm(v, axis=1)
    order = np.argsort(-v_norm, kind="stable")
    vid, v, vr, v_rest, v_norm = vid[order], v[order], vr[order], v_rest[order], v_norm[order]
    q_norm = np.linalg.norm(q, axis=1)
    slack = 1.0 + 1e-9 * q_norm.max(initial=0) * v_norm.max(initial=0)
    chunk = 1024
    none = -(2**62) - 1  # below any score here
    kept_s = np.full((len(q), k), none, np.int64)
    kept_i = np.zeros((len(q), k), np.int64)
    floor = floor.astype(np.float64).copy()
    for lo in range(0, len(v), chunk):
        hi = min(lo + chunk, len(v))
        alive = np.flatnonzero(q_norm * v_norm[lo] + slack >= floor)  # lengths fall: later rows are no longer
        if not len(alive):
            break
        bound = qr[alive, :lead] @ vr[lo:hi, :lead].T
        bound += q_rest[alive, None] * v_rest[None, lo:hi]
        hit = bound + slack >= floor[alive, None]
        some = np.flatnonzero(hit.any(1))
        if not len(some):
            continue
        cols = np.flatnonzero(hit.any(0))
        at = alive[some]
        exact = (q[at] @ v[lo:hi][cols].T).astype(np.int64) if plain else split_product(q[at], v[lo:hi][cols])
        exact[~hit[np.ix_(some, cols)]] = none
        ids = np.broadcast_to(vid[lo:hi][cols], exact.shape).copy()
        exact[ids == qid[at, None]] = none
        exact[exact < floor[at, None] - slack] = none
        s, i = np.concatenate([kept_s[at], exact], 1), np.concatenate([kept_i[at], ids], 1)
        top = np.lexsort((i, -s), axis=1)[:, :k] if s.shape[1] <= 4 * k else _top(s, i, k)
        kept_s[at], kept_i[at] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        full = kept_s[:, k - 1] > none
        floor[full] = np.maximum(floor[full], kept_s[full, k - 1].astype(np.float64) * (1 - 1e-15) - 1)
    rows, cols = np.nonzero(kept_s > none)
    return qid[rows], kept_i[rows, cols], kept_s[rows, cols].tolist()


def whole(c: float, scale: int) -> int:
    """floor(scale * c), without limit."""
    return math.floor(c * scale) if abs(c) < 2.0**900 else int(c) * scale


def best_of_large(qid, q, vid, v, k, scale):
    """As best, for components of any size (q and v not scaled): rounded scores in units of each query select, whole numbers decide."""
    dim = q.shape[1]

    def normal(x):
        """Rows of whole numbers divided by powers of two, and these powers."""
        power = np.frexp(np.abs(x).max(1))[1].astype(np.int64)
        small = np.abs(x) < 2.0**900
        y = np.where(small, np.floor(np.where(small, x, 0) * scale), x)
        return np.where(small, np.ldexp(y, -power[:, None]), np.ldexp(x, -power[:, None]) * scale), power

    a, _ = normal(q)
    b, power = normal(v)
    most = np.ldexp(np.ones(len(v)), np.maximum(power - power.max(initial=0), -1100))
    out = ([], [], [])
    numbers: dict[int, list[int]] = {}
    for lo in range(0, len(q), 256):
        s = a[lo : lo + 256] @ b.T
        error = 2.0**-50 * dim * (np.abs(a[lo : lo + 256]).max(1)[:, None] + 1) * (np.abs(b).max(1)[None, :] + 1)
        upper, lower = (s + error) * most + 1e-300, (s - error) * most - 1e-300
        own = qid[lo : lo + 256, None] == vid[None, :]
        lower[own] = upper[own] = -np.inf
        least = np.partition(lower, -k, axis=1)[:, -k] if len(v) >= k else np.full(len(s), -np.inf)
        for x in range(len(s)):
            some = np.flatnonzero((upper[x] >= least[x]) & ~own[x])
            mine = [whole(c, scale) for c in q[lo + x].tolist()]
            scored = []
            for j in some.tolist():
                if j not in numbers:
                    if len(numbers) > 100_000:
                        numbers.clear()
                    numbers[j] = [whole(c, scale) for c in v[j].tolist()]
                scored.append((-sum(map(int.__mul__, mine, numbers[j])), int(vid[j])))
            for score, j in sorted(scored)[:k]:
                out[0].append(qid[lo + x])
                out[1].append(j)
                out[2].append(-score)
    return out


def sort_key(score: int) -> str | None:
    """Orders as text the scores that a long does not tell apart."""
    if -(2**63) < score < 2**63 - 1:
        return None
    digits = f"{abs(score):x}"
    key = f"{len(digits):05d}{digits}"
    return "+" + key if score > 0 else "!" + key.translate(str.maketrans("0123456789abcdef", "fedcba9876543210"))


def _top(s, i, k):
    """Columns of each row's k largest s, ties to the smaller i."""
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    width = int((s >= least[:, None]).sum(1).max())
    if width > 4 * k:  # many ties: order whole rows
        return np.lexsort((i, -s), axis=1)[:, :k]
    near = np.argpartition(-s, width - 1, axis=1)[:, :width] if width < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    order = np.lexsort((np.take_along_axis(i, near, 1), -np.take_along_axis(s, near, 1)), axis=1)[:, :k]
    return np.take_along_axis(near, order, 1)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query (rows for which is_query, of vec_id, holds)."""
    rows = settle(taking_part(vectors, id_col, vector_col, scale))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.sum(is_query.cast("long")).alias("nq"), F.percentile_approx("norm2", [i / 1000 for i in range(1, 1000)], 100_000).alias("cuts")).first()
    if not facts["n"] or not facts["nq"]:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim, lead = facts["dim"], max(1, int(facts["dim"] * LEAD))
    r = rotation(rows, dim)
    n_blocks, q_blocks = -(-facts["n"] // block_rows), -(-facts["nq"] // block_rows)
    # a block is a range of lengths (blocks of one length are split by a hash of the id, so ties don't gather in one)
    bands = min(n_blocks, BANDS)
    edges = sorted({facts["cuts"][len(facts["cuts"]) * i // bands] for i in range(1, bands)}, reverse=True)
    band = reduce(lambda a, e: a + (F.col("norm2") < e).cast("int"), edges, F.lit(0))
    kinds = rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("top")).orderBy("band").collect()  # at most BANDS rows
    shape = [(x["band"], -(-x["n"] // block_rows), x["top"]) for x in kinds]
    parts = F.element_at(F.create_map(*[F.lit(y) for b, n, _ in shape for y in (b, n)]), F.col("band"))
    blocked = rows.withColumn("band", band).withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    longest = (F.col("band") == shape[0][0]) & (F.col("part") == 0)

    def meet(left: DataFrame, candidates: DataFrame, which: Column) -> DataFrame:
        """left: vec_id, v, norm2, qb, floor. Queries go to the blocks for which the column holds and whose longest row may reach their floor."""
        each_band = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(n).alias("n"), F.lit(float(top)).alias("top")) for b, n, top in shape]))
        reach = F.sqrt("norm2") * F.sqrt("to.top")
        copies = left.select("*", each_band.alias("to")).filter(reach * (1 + 1e-9) + 1 >= F.col("floor"))
        copies = copies.select("vec_id", "v", "floor", "qb", "to.band", F.explode(F.sequence(F.lit(0), F.col("to.n").cast("int") - 1)).alias("part")).filter(which)
        # which blocks of queries a band's rows go to: BANDS rows of at most one number a block
        served = copies.groupBy("band").agg(F.collect_set("qb").alias("qbs")).withColumnRenamed("band", "b")
        served = F.broadcast(served) if q_blocks * BANDS < 4_000_000 else served
        each_query = candidates.join(served, F.col("band") == F.col("b")).select("vec_id", "v", "band", "part", F.explode("qbs").alias("qb"))

        def run(key, qs: pa.Table, vs: pa.Table) -> pa.Table:
            empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "big": pa.array([], pa.string())}
            if not qs.num_rows or not vs.num_rows:
                return pa.table(empty)
            qid, q, vid, v = qs["q_id"].to_numpy(), _array(qs["q"], dim), vs["vec_id"].to_numpy(), _array(vs["v"], dim)
            if np.abs(q).max() * scale < 2.0**40 and np.abs(v).max() * scale < 2.0**40 and (np.abs(q).max() * scale + 1) * (np.abs(v).max() * scale + 1) * dim < 2.0**62:
                ids, found, scores = best(qid, np.floor(q * scale), vid, np.floor(v * scale), r, k, qs["floor"].to_numpy(), lead)
            else:
                ids, found, scores = best_of_large(qid, q, vid, v, k, scale)
            shown = [min(max(x, -(2**63)), 2**63 - 1) for x in scores]
            return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(shown, pa.int64()), "big": pa.array(map(sort_key, scores), pa.string())})

        copies = copies.toDF("q_id", "q", "floor", "q_qb", "q_band", "q_part")  # other names than the rows' own
        return copies.groupBy("q_band", "q_part", "q_qb").cogroup(each_query.groupBy("band", "part", "qb")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint, big string")

    lowest = float("-inf")
    queries = rows.filter(is_query).select("vec_id", "v", "norm2")
    first = queries.withColumns({"qb": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int"), "floor": F.lit(lowest)})
    first = settle(meet(first.select("vec_id", "v", "norm2", "qb", "floor"), blocked.filter(longest), longest))
    # a long that stands for a smaller score is no floor
    floors = first.groupBy("query_id").agg(F.when((F.count(F.lit(1)) >= k) & (F.min("score") > -(2**62)), F.min("score").cast("double") * (1 - 1e-15 * F.signum(F.min("score"))) - 1).otherwise(lowest).alias("floor"))
    known = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select("vec_id", "v", "norm2", F.coalesce("floor", F.lit(lowest)).alias("floor"))
    known = settle(known.withColumn("need", F.when(F.col("norm2") > 0, F.col("floor") / F.sqrt("norm2")).otherwise(lowest)))
    cuts = known.agg(F.percentile_approx("need", [i / BANDS for i in range(1, BANDS)], 10_000)).first()[0] if q_blocks > 1 else []
    ranges = min(q_blocks, BANDS)
    q_edges = sorted({cuts[len(cuts) * i // ranges] for i in range(1, ranges)}) if cuts else []
    q_range = reduce(lambda a, e: a + (F.col("need") >= e).cast("int"), q_edges, F.lit(0))
    each = -(-q_blocks // ranges)  # blocks to a range
    known = known.withColumn("qb", (q_range * each + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(each))).cast("int"))
    found = first.unionByName(meet(known.select("vec_id", "v", "norm2", "qb", "floor"), blocked.filter(~longest), ~longest))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("big").desc_nulls_last(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
