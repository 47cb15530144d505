"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

The document rates that lie closest (in relative entropy) to one copy each, are at most
``most`` copies, and give a source its target of tokens are

    r_i = min(most, exp(lambda_s * size_i)),    sum over the source's i of size_i * r_i = target_s,

where lambda_s is the minimum of the convex dual  sum_i phi(lambda_s * size_i) - lambda_s * target_s,
phi' being min(most, exp).  Newton's method solves all sources at once.  Gradient and Hessian are sums over documents,
one distributed, map-side combined aggregate a step, over the counts of documents by source and
size (rates depend on nothing else), so a hot source is at most its distinct sizes.  Steps are
Newton's on the logarithm of the sum, which is nearly straight, and fall back to halving where they
leave the bracket; the driver sees only whether a source is left to solve.  A source that gets less than it
has thins its long documents most, one that gets more repeats those most, up to the cap.

Rates become whole copies by systematic rounding in size order within bounded
(source, bucket) groups, whose error telescopes to less than one document a
bucket.  What is left of each source's target is then met by adding or removing a
copy of few documents of falling size (at most SLOTS per size class and source).

Defined cases: null text has size 0; a null source is a source, ranked last;
documents of size 0 take 0; an empty table gives an empty result; repeated rows
count as documents of their own; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, settle

#: Rows of a (source, bucket) group, on average.
BUCKET_ROWS = 2_000
#: Documents of a size class and source whose copies may be corrected.
SLOTS = 8


def source_targets(sized: DataFrame, weights=(5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """source, source_size, n, target: weights by rank of the source, water-filled under most * size."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    rows = (
        totals.withColumn("w", w)
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("w"))
    )
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("capped", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_rest", F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("w_rest"))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.least("cap", F.col("w") * level)).select("source", "source_size", "n", "target")


def rate_of(most: float) -> Column:
    """A document's rate, from its size and its source's tilt; 0 where there is nothing to take."""
    return F.when((F.col("size") > 0) & (F.col("target") > 0), F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size")))).otherwise(F.lit(0.0))


def tilt(sized: DataFrame, targets: DataFrame, most: float = 3.0, tolerance: float = 1e-10) -> DataFrame:
    """Adds each source's tilt (the dual's lambda, null without words or target): as many Newton steps as the hardest source takes."""
    sizes = settle(sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).cast("double").alias("c")))
    ratio = F.col("target") / F.col("source_size")
    solvable = (F.col("source_size") > 0) & (F.col("target") > 0)
    lean = sizes.groupBy("source").agg((F.sum(F.col("c") * F.col("size") * F.col("size")) / F.sum(F.col("c") * F.col("size"))).alias("weighted")).withColumnRenamed("source", "s")
    state = targets.join(lean, targets["source"].eqNullSafe(lean["s"]), "left").drop("s").withColumns(
        {
            # sizes are 1 or more, so these enclose the answer
            "low": F.when(ratio < 1, F.log(ratio)).otherwise(0.0),
            "high": F.when(ratio < 1, 0.0).otherwise(F.log(F.lit(float(most)))),
            "tilt": F.when(~solvable, None).when(ratio >= most, F.log(F.lit(float(most)))).otherwise(F.log(ratio) / F.col("weighted")),
            "open": solvable & (ratio < most) & (ratio != 1),
        }
    )
    state = settle(state.drop("weighted"))
    while state.filter("open").limit(1).count():
        now = state.filter("open").select(F.col("source").alias("s"), "tilt")
        raw = F.exp(F.col("tilt") * F.col("size"))
        each = sizes.join(now, sizes["source"].eqNullSafe(now["s"])).select("s", (F.col("c") * F.col("size")).alias("w"), "size", F.least(raw, F.lit(float(most))).alias("r"), (raw < most).alias("free"))
        sums = each.groupBy("s").agg(F.sum(F.col("w") * F.col("r")).alias("got"), F.sum(F.when(F.col("free"), F.col("w") * F.col("size") * F.col("r")).otherwise(0.0)).alias("slope"))
        met = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        met = met.withColumns({"low": F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))})
        step = F.col("tilt") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        middle = (F.col("low") + F.col("high")) / 2
        left = F.col("open") & (F.abs(F.col("got") - F.col("target")) > tolerance * F.col("target")) & (middle > F.col("low")) & (middle < F.col("high"))
        after = F.when((F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high")), step).otherwise(middle)
        met = met.withColumn("next", F.when(left, after).otherwise(F.col("tilt"))).withColumn("open", F.coalesce(left, F.lit(False)))
        state = settle(met.withColumn("tilt", F.col("next")).select(state.columns))
    return state.drop("low", "high", "open")


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    small = settle(sized.withColumn("rid", F.monotonically_increasing_id()))
    rates = tilt(small, settle(source_targets(small, weights, float(most))), float(most))
    counted = settle(_copies(small, rates, most))
    last = _corrections(counted, rates, most)
    return (
        counted.join(last, "rid", "left")
        .withColumn("copies", F.col("copies") + F.coalesce("delta", F.lit(0)))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes it.

    Texts are shuffled once, by a hash of (doc_id, source, size); rows that share all three meet their copy numbers in order.
    """
    key = F.xxhash64(F.col("id"), F.col("source"), F.col("size"))
    taken = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **how).withColumnRenamed("doc_id", "id")
    copies = taken.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(F.struct("id", "source", "size", "copies"))).alias("cs"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    order = Window.partitionBy("key").orderBy("id", "source", "size")
    rows = rows.withColumn("key", key).withColumn("k", F.row_number().over(order))
    met = rows.join(copies, "key").withColumn("copies", F.element_at("cs", F.col("k"))["copies"]).filter("copies > 0")
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _copies(rows: DataFrame, rates: DataFrame, most: int) -> DataFrame:
    """Whole copies by systematic rounding; the groups follow the size class and a hash, so a hot source spreads."""
    h = F.xxhash64("doc_id", "size")
    joined = rows.join(rates, rows["source"].eqNullSafe(rates["source"])).drop(rates["source"])
    joined = joined.withColumns(
        {"h": h, "class": F.length(F.bin("size")), "bucket": F.pmod(h, F.ceil(F.col("n") / F.lit(BUCKET_ROWS)))}
    )
    group = Window.partitionBy("source", "class", "bucket").orderBy("size", "h", "doc_id")
    u = F.pmod(F.xxhash64("source", "class", "bucket"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    joined = joined.withColumn("rate", rate_of(most))
    upto = F.sum("rate").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.coalesce(F.sum("rate").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    copies = F.floor(u + upto) - F.floor(u + before)
    return joined.withColumn("copies", F.least(copies, F.lit(most)).cast("long")).drop("bucket", "n", "tilt")


def _corrections(counted: DataFrame, rates: DataFrame, most: int) -> DataFrame:
    """rid, delta: few documents per source whose copies change by one to meet the rest of the target."""
    off = counted.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
    able = counted.filter("size > 0 and rate > 0")
    slot = F.pmod("h", F.lit(SLOTS)).alias("slot")
    picked = able.groupBy("source", "class", slot).agg(F.min(F.struct("h", "doc_id", "rid", "size", "copies")).alias("c")).select("source", "c.*")
    # what smaller ones among the picked could still add or take away
    smaller = Window.partitionBy("source").orderBy("size", "h", "rid").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda able: F.coalesce(F.sum(F.when(able, F.col("size"))).over(smaller), F.lit(0)).cast("double")
    picked = picked.withColumns({"add": below(F.col("copies") < most), "less": below(F.col("copies") > 0)})
    lists = picked.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "h", "rid", "copies", "add", "less")), asc=False).alias("cs"))
    miss = lambda x: f"greatest(0D, {x} - c.add, -({x}) - c.less)"
    change = lambda x, d: f"struct({x} AS off, array_append(s.changed, struct(c.rid AS rid, {d}L AS delta)) AS changed)"
    more, fewer = f"IF(c.copies < {most}, {miss('s.off - c.size')}, 1e300D)", f"IF(c.copies > 0, {miss('s.off + c.size')}, 1e300D)"
    folded = lists.join(off, lists["source"].eqNullSafe(off["source"])).select(
        F.expr(
            f"""
            aggregate(cs, struct(off AS off, cast(array() AS array<struct<rid: bigint, delta: bigint>>) AS changed), (s, c) ->
                CASE WHEN {miss('s.off')} <= least({more}, {fewer}) THEN s
                     WHEN {more} <= {fewer} THEN {change('s.off - c.size', 1)}
                     ELSE {change('s.off + c.size', -1)} END).changed
            """
        ).alias("changed")
    )
    return folded.select(F.explode("changed").alias("x")).select("x.rid", "x.delta")
