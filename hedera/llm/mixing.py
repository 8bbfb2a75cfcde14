"""Mixing sources to target weights: entropy balancing by Newton steps on the dual, then rounding into copies."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, table, written


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources (source, total, ...) with target: share * the sum of totals, dealt by weight, none above most * its total.

    Sources in order of code points, null last, take the weights in turn, repeating. The excess over a limit is dealt again
    by weight until none is above: targets are min(limit, level * weight) for the level that spends the sum. A source at
    its limit has the smallest limits a weight, so running sums in that order give the level.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1))
    s = s.withColumn("limit", F.col("total") * float(most)).withColumn("ratio", F.col("limit") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("total").over(all_rows) * float(share) - F.coalesce(F.sum("limit").over(up), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.col("rest"))
    # The first source that stays under its limit has the level of all after it.
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(all_rows)["level"]
    return s.withColumn("target", F.when(level.isNull(), F.col("limit")).otherwise(F.least("limit", level * F.col("w")))).drop("w", "ratio", "left", "rest", "level", "limit")


def balanced(sizes: DataFrame, state: DataFrame, most: float, tolerance: float = 1e-10, steps: int = 100) -> DataFrame:
    """state with lam: documents of size x get the rate min(most, exp(lam * x / mean)), and sum(rate * x) is the target.

    That is the solution of least relative entropy to a rate of 1 under the source's token constraint and the limit. lam
    solves the convex dual; each step is one aggregation over (source, size, count), from which Newton's step on the
    logarithm of the sum follows, kept inside the bracket that the sums so far have proved. A source whose target is at its
    limit has lam = infinity, that is, the rate most for all.
    """
    start = F.log(F.col("target") / F.col("total"))
    state = state.withColumn("full", F.col("target") >= F.col("total") * most * (1 - 1e-12))
    state = written(state.select("*", F.when((F.col("total") <= 0) | F.col("full"), F.lit(0.0)).otherwise(start * F.col("total") * F.col("mean") / F.col("square")).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), (F.col("full") | (F.col("total") <= 0)).alias("done")))
    columns = state.columns
    for _ in range(steps):
        s = state.select(F.col("source").alias("_source"), F.col("lam").alias("_lam"), F.col("mean").alias("_mean")).where(~F.col("done"))
        x = F.col("size") / F.col("_mean")
        free = F.col("_lam") * x < math.log(most)
        rate = F.when(free, F.exp(F.col("_lam") * x)).otherwise(most)
        sums = sizes.join(s, F.col("source").eqNullSafe(F.col("_source"))).groupBy("_source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("_g"), F.sum(F.when(free, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("_h"))
        j = state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left")
        over = F.col("_g") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.when(F.col("_h") > 0, F.log(F.col("_g") / F.col("target")) * F.col("_g") / F.col("_h"))
        middle = F.when(F.isnan(lo + hi) | (F.abs(lo + hi) == float("inf")), F.col("lam") + F.when(over, -1.0).otherwise(1.0) * (1 + F.abs("lam"))).otherwise((lo + hi) / 2)
        good = F.abs(F.col("_g") - F.col("target")) <= tolerance * F.col("target")
        stuck = (F.abs(hi - lo) <= 1e-15 * F.abs(F.col("lam")))
        new = F.when(F.col("done") | good, F.col("lam")).when((step > lo) & (step < hi), step).otherwise(middle)
        keep = F.col("done") | F.coalesce(good | stuck, F.lit(True))
        after = written(j.select(*(c for c in columns if c not in ("lam", "lo", "hi", "done")), new.alias("lam"), F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"), keep.alias("done")).select(*columns))
        dropped(state)
        state = after
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state.withColumn("lam", F.when(F.col("full"), F.lit(float("inf"))).otherwise(F.col("lam")))


def _copies(most: int):
    """Whole copies for one bucket, largest documents first: each takes the number that brings words taken nearest to the rates' sum so far."""

    def run(group: pa.Table) -> pa.Table:
        size, rate = group["size"].to_numpy(), group["rate"].to_numpy()
        order = np.lexsort((group["tie"].to_numpy(), -size))
        copies, owed = np.zeros(len(size), np.int64), 0.0
        for i in order.tolist():
            x = int(size[i])
            owed += rate[i] * x
            if x:
                copies[i] = c = min(most, max(0, math.floor(owed / x + 0.5)))
                owed -= c * x
            else:
                copies[i] = 1
        return group.drop_columns(["bucket", "rate", "tie"]).append_column("copies", pa.array(copies))

    return run


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, bucket_rows: int = 512) -> DataFrame:
    """A row per row of docs: doc_id, source, size (words), source_size, target, copies (0 to most), taken (copies * size), and tag.

    docs: doc_id, source, text; other columns are ignored. tag is a hash of (doc_id, source, text), for joining copies back
    to rows. A null text has size 0; documents without words take one copy and no words. Null sources are one source, the
    last. Repeated rows stay and are rounded each on its own. An empty table gives an empty result.

    Texts are read once, for their sizes. Targets need a row per source, Newton's steps a row per distinct size of a source.
    Rates are rounded in buckets of about bucket_rows documents by a hash of the document, so a hot source spreads over as
    many tasks as it needs; in a bucket words taken differ from the rates' sum by less than its smallest sizes.
    """
    tag = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))
    rows = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), tag.alias("tag")))
    hist = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    z = F.col("size").cast("double")
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("docs"), F.sum(z * z * F.col("n")).alias("square"))
    state = targets(sources, weights, share, most).withColumn("mean", F.greatest(F.col("total") / F.col("docs"), F.lit(1e-9)))
    state = balanced(hist.where("size > 0"), state, most)
    s = state.select(F.col("source").alias("_source"), F.col("total").alias("source_size"), "target", "lam", "mean", "docs")
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("lam") == float("inf"), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * x)))
    bucket = F.xxhash64("source", F.pmod(F.xxhash64("doc_id", "tag"), F.ceil(F.col("docs") / bucket_rows)))
    dealt = rows.join(s, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "tag", "size", "source_size", "target", rate.alias("rate"), bucket.alias("bucket"), F.xxhash64("tag", F.lit(3)).alias("tie"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = dealt.groupBy("bucket").applyInArrow(_copies(most), f"doc_id {id_type}, source string, tag long, size long, source_size long, target double, copies long")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "copies")
