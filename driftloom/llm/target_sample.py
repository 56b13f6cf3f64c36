"""Samples with target shares per category.

Categories are counted, integer quotas are allotted by largest remainder between a floor (the wanted minimum) and a cap
(what there is), and the rows with the least random keys of each category are taken. A category of any size is safe:
keys are counted in buckets, whole buckets below the quota are taken, and only the one bucket the quota falls into is ranked.

Defined cases: rows with a null id or category are not eligible; an id counts once, with its least category; categories
without target are counted but not drawn; a target category without rows has quota 0 and is reported short; an empty
table gives an empty sample. Ties of the random key go by id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.hashing import portable_hash
from driftloom.llm.textunits import trimmed
from driftloom.session import small_rows

#: Buckets of the random key; 1/BUCKETS of a category is ranked.
BUCKETS = 4096


def eligible(df: DataFrame, key: str, category: str) -> DataFrame:
    """(id, category): each id with a category once; the category as text, trimmed and in lower case."""
    own = df.select(F.col(key).cast("string").alias("id"), F.lower(trimmed(F.col(category).cast("string"))).alias("category"))
    return own.where("id IS NOT NULL AND category IS NOT NULL").groupBy("id").agg(F.min("category").alias("category"))


def allot(size: int, shares: list[float], floors: list[int], caps: list[int]) -> list[int]:
    """Integer quotas that sum to ``size`` as far as floors and caps allow, in proportion to the shares."""
    low = [min(f, c) for f, c in zip(floors, caps)]
    size = max(min(size, sum(caps)), sum(low))
    free, fixed, ideal = set(range(len(shares))), dict[int, float](), dict[int, float]()
    while free:
        rest, weight = size - sum(fixed.values()), sum(shares[i] for i in free)
        ideal = {i: rest * shares[i] / weight if weight else rest / len(free) for i in free}
        over = {i for i in free if ideal[i] > caps[i]}
        under = {i for i in free if ideal[i] < low[i]}
        # clip the side that is off by more, so that the rest can still make up for it
        push = over if sum(ideal[i] - caps[i] for i in over) >= sum(low[i] - ideal[i] for i in under) else under
        if not push:
            break
        fixed |= {i: caps[i] if push is over else low[i] for i in push}
        free -= push
    quotas = [int(fixed[i]) if i in fixed else math.floor(ideal[i]) for i in range(len(shares))]
    by_remainder = sorted(free, key=lambda i: (-(ideal[i] - math.floor(ideal[i])), i))
    for i in by_remainder[: max(0, size - sum(quotas))]:
        quotas[i] += quotas[i] < caps[i]
    return quotas


def quota_report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target category: available rows, wanted rows, quota, whether the target is missed.

    ``targets``: target_field, category, target_share, min_rows, sample_frac of one field (a small table). A target is
    missed if the category has fewer rows than the larger of min_rows and target_share × sample_frac × all rows.
    """
    spark, wanted = rows.sparkSession, sorted(small_rows(targets.where("category IS NOT NULL")), key=lambda r: r["category"])
    named = F.col("category").isin([r["category"].strip().lower() for r in wanted])
    counted = {r["c"]: r["n"] for r in rows.groupBy(F.when(named, F.col("category")).alias("c")).agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    have = [counted.get(r["category"].strip().lower(), 0) for r in wanted]
    share, least, frac = [r["target_share"] or 0.0 for r in wanted], [r["min_rows"] or 0 for r in wanted], [r["sample_frac"] or 0.0 for r in wanted]
    quotas = allot(round(max(frac, default=0.0) * total), share, least, have)
    needed = [max(float(m), s * f * total) for m, s, f in zip(least, share, frac)]
    out = [(r["target_field"], r["category"], r["target_share"], h, n, q, h < n) for r, h, n, q in zip(wanted, have, needed, quotas)]
    return spark.createDataFrame(out, "target_field string, category string, target_share double, available long, wanted double, quota long, missed boolean")


def draw(rows: DataFrame, report: DataFrame, seed: int = 42) -> DataFrame:
    """(id, category): of each category of the report its quota of rows, those with the least random keys."""
    quota = F.broadcast(report.select(F.lower(trimmed(F.col("category"))).alias("category"), "quota").where("quota > 0"))  # a row per target
    # a portable hash of 60 bits, its first 12 the bucket
    keyed = rows.join(quota, "category").withColumn("_key", portable_hash(F.col("id"), seed)).withColumn("_bucket", F.shiftright("_key", 48).cast("int"))
    counts = keyed.groupBy("category", "quota", "_bucket").agg(F.count("*").alias("_n"))
    upto = W.partitionBy("category").orderBy("_bucket")
    left = counts.withColumn("_left", F.col("quota") - F.coalesce(F.sum("_n").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    left = F.broadcast(left.where("_left > 0").select("category", "_bucket", "_left", "_n"))  # at most BUCKETS rows a target
    near = keyed.join(left, ["category", "_bucket"])
    sure = near.where("_n <= _left").select("id", "category")
    ranked = near.where("_n > _left").withColumn("_rank", F.row_number().over(W.partitionBy("category").orderBy("_key", "id")))
    return sure.unionByName(ranked.where("_rank <= _left").select("id", "category"))


def sample_report(rows: DataFrame, report: DataFrame, seed: int = 42) -> DataFrame:
    """The report with ``sampled``, the rows of each category really drawn, ``sampled_share``, and ``short``: fewer than wanted were
    drawn, and no more could be.
    """
    drawn = draw(rows, report, seed).groupBy("category").agg(F.count("*").alias("sampled")).withColumnRenamed("category", "_c")
    both = report.join(F.broadcast(drawn), F.lower(trimmed(F.col("category"))) == F.col("_c"), "left").drop("_c").withColumn("sampled", F.coalesce("sampled", F.lit(0)))  # a row per target
    share = F.coalesce(F.try_divide(F.col("sampled"), F.sum("sampled").over(W.partitionBy())), F.lit(0.0))
    # the draw tells who comes short; the count of what there is tells rounding from want
    return both.withColumn("sampled_share", F.round(share, 6)).withColumn("short", (F.col("sampled") < F.col("wanted")) & F.col("missed"))
