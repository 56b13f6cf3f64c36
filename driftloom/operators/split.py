"""Deterministic train/test split with nested samples for feature search and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.hashing import portable_hash
from driftloom.session import HASH_SHIFT, hash_edges

FLAGS = ("_is_train", "_is_feature_search", "_is_feature_eval")
BUCKETS = 1000


def split(df: DataFrame, key: str, train_fraction: float = 0.8, search_rows: int = 10_000, eval_rows: int = 100_000, seed: int = 42) -> DataFrame:
    """``df`` with three flags. Train is decided by the key's hash; search and eval are the first train rows in hash order,
    so the smaller of them lies within the larger; 0 rows need no look at the data. ``key`` must be unique.

    The n-th smallest (hash, key) of the train rows is found in the one bucket of the hash that holds it; the flags then are
    expressions of the row, and a filter by them needs no join.
    """
    if not 0 < train_fraction <= 1:
        raise ValueError("train_fraction must be in (0, 1]")
    h = portable_hash(F.col(key), seed)
    hashed = df.withColumn("_h", h).withColumn("_is_train", F.col("_h") % BUCKETS < int(train_fraction * BUCKETS))
    sizes = {"_is_feature_search": search_rows, "_is_feature_eval": eval_rows}
    for name, last in _last_rows(hashed.where("_is_train").select("_h", F.col(key).alias("_k")), sizes).items():
        inside = last is ALL or (F.lit(False) if last is None else (F.col("_h") < last[0]) | (F.col("_h") == last[0]) & (F.col(key) <= F.lit(last[1])))
        hashed = hashed.withColumn(name, F.col("_is_train") & (F.lit(True) if inside is True else inside))
    return hashed.drop("_h")


#: All rows are inside.
ALL = object()


def _last_rows(train: DataFrame, sizes: dict[str, int]) -> dict:
    """(hash, key) of the last of the first so many rows; ``ALL`` if there are no more, none for no rows."""
    asked = {name: n for name, n in sizes.items() if n > 0}
    out: dict = dict.fromkeys(sizes)
    if not asked:
        return out
    edges = dict(zip(asked, hash_edges(train, "_h", list(asked.values()))))
    out |= {name: ALL for name, e in edges.items() if e is None}
    found = [
        train.where(F.shiftright("_h", HASH_SHIFT) == e[0]).orderBy("_h", "_k").limit(e[1]).agg(F.max(F.struct("_h", "_k")).alias("last")).select(F.lit(name).alias("name"), "last")
        for name, e in edges.items() if e is not None
    ]
    if found:
        out |= {r["name"]: (r["last"]["_h"], r["last"]["_k"]) for r in reduce(DataFrame.unionByName, found).collect()}
    return out


def part(flagged: DataFrame, name: str) -> DataFrame:
    """The rows of ``train``, ``test``, ``feature_search`` or ``feature_eval``, without the flags."""
    keep = ~F.col("_is_train") if name == "test" else F.col(f"_is_{name}")
    return flagged.where(keep).drop(*FLAGS)


def drop_flags(flagged: DataFrame) -> DataFrame:
    return flagged.drop(*FLAGS)


def shares(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f)).alias(f.removeprefix("_is_") + "_rows") for f in FLAGS))


