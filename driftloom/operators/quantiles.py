"""Exact quantiles of any number of groups at any size.

An approximate sketch brackets each wanted quantile; only the values inside the brackets are counted by value and ordered.
The result is exact (linear interpolation), no task holds a group, and repeated values cost one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.session import broadcast_if_small, cut_lineage, placed

#: Rank error of the sketch is about 1/ACCURACY; the bracket is wider by MARGIN times that.
ACCURACY, MARGIN = 1000, 4


def exact_quantiles(df: DataFrame, group: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(group…, quantiles array<double>, n): nulls and NaN are left out."""
    own = df.select(*group, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    slack = MARGIN / ACCURACY
    low, high = ([min(max(p + s, 0.0), 1.0) for p in probabilities] for s in (-slack, slack))
    sketch = own.groupBy(*group).agg(
        F.percentile_approx("_v", low, ACCURACY).alias("_lo"), F.percentile_approx("_v", high, ACCURACY).alias("_hi"), F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    # of few values the bracket is all of them: the neighbours of a rank may lie outside any narrower one
    few = F.col("_n") <= ACCURACY
    sketch = sketch.select(*group, "_n", F.when(few, F.transform("_lo", lambda x: F.col("_min"))).otherwise(F.col("_lo")).alias("_lo"), F.when(few, F.transform("_hi", lambda x: F.col("_max"))).otherwise(F.col("_hi")).alias("_hi"))
    sketch = broadcast_if_small(cut_lineage(sketch)) if group else F.broadcast(sketch)
    # null-safe group keys, on the small side of the join
    on = [F.col(f"_l.{g}").eqNullSafe(F.col(f"_r.{g}")) for g in group]
    both = own.alias("_l").join(sketch.alias("_r"), on or F.lit(True))
    both = both.select(*(F.col(f"_l.{g}").alias(g) for g in group), "_v", "_lo", "_hi", "_n")
    # per value and quantile: 0 below the bracket, 1 inside; below is only counted
    each = both.select(*group, "_n", "_v", F.explode(F.expr("filter(transform(_lo, (l, i) -> struct(i AS q, CASE WHEN _v < l THEN 0 WHEN _v <= _hi[i] THEN 1 ELSE 2 END AS side)), x -> x.side < 2)")).alias("_x"))
    counted = each.select(*group, "_n", "_x.q", F.when(F.col("_x.side") == 1, F.col("_v")).alias("_v")).groupBy(*group, "_n", "q", "_v").agg(F.count("*").alias("_c"))
    upto = W.partitionBy(*group, "q").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_to", F.sum("_c").over(upto))  # values below come first, as null
    h = (F.col("_n") - 1) * F.element_at(F.array(*map(F.lit, map(float, probabilities))), F.col("q") + 1)
    ranked = ranked.withColumn("_h", h).where("_v IS NOT NULL")
    at = lambda r: F.min(F.when(F.col("_to") >= r + 1, F.col("_v")))
    floor = F.floor("_h")
    ends = ranked.groupBy(*group, "_n", "q", "_h").agg(at(F.floor("_h")).alias("_a"), at(F.ceil("_h")).alias("_b"))
    mixed = ends.select(*group, "_n", "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - floor)).alias("_x"))
    return mixed.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "_x"))), lambda s: s["_x"]).alias("quantiles"), F.max("_n").alias("n"))


def rank_averages(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): the average rank of each distinct value, ties averaged; values are sorted by range over the whole cluster."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    return placed(counts, [value], {"_before": "_c"}).select(value, (F.col("_before") + (F.col("_c") + 1) / 2).alias(out))
