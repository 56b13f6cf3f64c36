"""Row samples: first rows, consecutive rows from a random start, random, proportional and balanced by class or by range.

"Random" is the order of a keyed hash, so a sample is the same on every run and cluster layout. Samples by class rank rows
inside classes with a literal bound, which Spark applies in every partition before the shuffle: a large class costs no more.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.hashing import portable_hash
from driftloom.session import least_rows, placed, small_rows

#: First rows up to which every partition may send as many to one task.
TOP_K = 10_000


def _check(df: DataFrame, n: int, *columns: str) -> None:
    if n <= 0:
        raise ValueError("the sample size must be positive")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows: a top-k where k is small, else by their places in a sort over the whole cluster."""
    return _first(df, key, F.col(key), n)


def _first(df: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    _check(df, n, key)
    return df.orderBy(order).limit(n) if n <= TOP_K else placed(df, [order], {"_at": None}).where(F.col("_at") < n).drop("_at")


def tail(df: DataFrame, key: str, n: int) -> DataFrame:
    return _first(df, key, F.desc(key), n)


def random_start(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows that follow each other in the order of a unique key, from a seeded random place."""
    _check(df, n, key)
    first = random.Random(seed).randint(0, max(0, df.count() - n))
    return placed(df, [key], {"_at": None}).where(F.col("_at").between(first, first + n - 1)).drop("_at")


def uniform(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if there are fewer) with the least hashes."""
    _check(df, n, key)
    return least_rows(df.withColumn("_h", portable_hash(F.col(key), seed)), "_h", key, n).drop("_h")


def _first_of_each(df: DataFrame, key: str, group: Column, quota: Column, most: int, seed: int) -> DataFrame:
    ranked = df.withColumn("_g", group).withColumn("_q", quota).withColumn("_h", portable_hash(F.col(key), seed))
    ranked = ranked.withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy("_h", key))).where(F.col("_r") <= max(most, 1))
    return ranked.where("_r <= _q").drop("_g", "_q", "_h", "_r")


def _by_name(quotas: dict, column: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, q in quotas.items():
        out = F.when(column.eqNullSafe(F.lit(name)), F.lit(q)).otherwise(out)
    return out


def by_class(df: DataFrame, key: str, column: str, n: int, balanced: bool = False, seed: int = 42, max_classes: int = 1000) -> DataFrame:
    """Proportional: ``max(1, round(n·share))`` rows of each class, halves to even. Balanced: ``n // classes`` of each."""
    _check(df, n, key, column)
    counts = {r[column]: r["count"] for r in small_rows(df.groupBy(column).count(), max_classes)}
    total = sum(counts.values())
    if total <= n and not balanced:
        return df
    quotas = {c: n // len(counts) if balanced else max(1, round(n * k / total)) for c, k in counts.items()}
    return _first_of_each(df, key, F.col(column), _by_name(quotas, F.col(column)), max(quotas.values(), default=0), seed)


def by_range(df: DataFrame, key: str, column: str, n: int, bins: int = 5, balanced: bool = False, seed: int = 42) -> DataFrame:
    """Proportional: ``bins`` bins of equal row count by position, ``divmod(n, bins)`` rows of each.
    Balanced: bins of equal width ``(low, high]``, ``n // bins`` rows of each; a constant column gives a uniform sample.
    """
    _check(df, n, key, column)
    if bins < 2:
        raise ValueError("at least two bins")
    own = df.where(F.col(column).isNotNull())
    if balanced:
        ends = own.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        if ends["lo"] is None or ends["lo"] == ends["hi"]:
            return uniform(df, key, n, seed)
        bin_no = F.greatest(F.ceil((F.col(column) - F.lit(ends["lo"])) / F.lit((ends["hi"] - ends["lo"]) / bins)), F.lit(1))
        return _first_of_each(own, key, F.least(bin_no, F.lit(bins)), F.lit(n // bins), n // bins, seed)
    total = own.count()
    ranked = placed(own, [column, key], {"_at": None})
    # bin i holds the positions [i·total/bins, (i+1)·total/bins), integer division
    bin_no = sum((F.when(F.col("_at") >= (i * total) // bins, 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    each, rest = divmod(n, bins)
    return _first_of_each(ranked, key, bin_no, F.when(bin_no < rest, each + 1).otherwise(each), each + 1, seed).drop("_at")
