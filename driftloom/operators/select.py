"""Choosing a small set of features that add to each other.

One distributed pass computes the centred Gram matrix of all features and targets (with a column of ones); the greedy choice
then works on that small matrix in the driver, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_GAIN = 1e-8
#: Features of one Gram matrix; it is this number squared that reaches the driver.
MOST_FEATURES = 5000
#: Numbers of partial matrices that meet in one task, and partitions for which the tree of sums is deep enough.
PARTIAL_DOUBLES, MOST_PARTS = 8_000_000, 500_000


def gram_matrix(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """Sums of the products of the columns around their means, over rows where all are finite; the last row and column hold
    the means and, in the corner, the number of rows.

    One pass: every partition multiplies its batches with themselves, and the partial matrices are added row by row in a tree.
    Columns are taken around their first finite row, so that large means don't swallow the differences.
    """
    if len(columns) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} columns")
    n = len(columns)
    names = [f"c{i}" for i in range(n)]
    wide = df.select(*(c.cast("double").alias(name) for c, name in zip(columns, names)))
    finite = lambda pdf: (lambda m: m[np.isfinite(m).all(axis=1)])(pdf.to_numpy(dtype=np.float64, na_value=np.nan))

    def one(batches):
        for pdf in batches:
            if len(m := finite(pdf)):
                yield pd.DataFrame({"v": [m[0]]})
                return

    first = wide.mapInPandas(one, "v array<double>").first()
    if first is None:
        return np.zeros((n + 1, n + 1))
    around = np.array(first["v"])

    def multiply(batches):
        total = np.zeros((n + 1, n + 1))
        for pdf in batches:
            m = finite(pdf) - around
            m = np.hstack([m, np.ones((len(m), 1))])
            total += m.T @ m
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"i": np.arange(n + 1, dtype="int32"), "part": np.full(n + 1, part, dtype="int32"), "row": list(total)})

    # as many partial rows meet in a task as are bounded in bytes
    at_once = max(64, PARTIAL_DOUBLES // (n + 1))

    def add(pdf):
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "part": pdf["part"].iloc[:1] // at_once, "row": [np.stack(pdf["row"].to_numpy()).sum(axis=0)]})

    schema = "i int, part int, row array<double>"
    sums, covered = wide.mapInPandas(multiply, schema), 1
    while covered < MOST_PARTS:
        sums = sums.groupBy("i", F.floor(F.col("part") / at_once).alias("_p")).applyInPandas(add, schema)
        covered *= at_once
    out = np.zeros((n + 1, n + 1))
    for r in sums.collect():  # a row per column
        out[r["i"]] += r["row"]
    return _centred(out, around)


def _centred(g: np.ndarray, around: np.ndarray) -> np.ndarray:
    """From sums of columns taken around a point: products around the means; the last row has the means and the number of rows."""
    n, s = g[-1, -1], g[-1, :-1]
    out = np.zeros_like(g)
    if n:
        out[:-1, :-1] = g[:-1, :-1] - np.outer(s, s) / n
        out[-1, :-1] = out[:-1, -1] = around + s / n
    out[-1, -1] = n
    return out


def _residual(g: np.ndarray, xs: list[int], y: int) -> float:
    """Sum of squared residuals of y on the columns xs and 1. A singular system of one column predicts the mean, of two nothing (zeros)."""
    try:
        beta = np.linalg.solve(g[np.ix_(xs, xs)], g[xs, y])
    except np.linalg.LinAlgError:
        return float(g[y, y] + (0 if len(xs) == 1 else g[-1, -1] * g[-1, y] ** 2))
    return float(g[y, y] - beta @ g[xs, y])


def greedy_choice(g: np.ndarray, names: list[str], columns: list[list[int]], ys: list[int], most: int) -> list[tuple[str, float]]:
    """(name, score) in order of choice from centred products (``gram_matrix``).

    ``columns``: of each feature its column for each target; ``ys``: the targets' columns. The first is the feature that alone
    lowers the residual deviation most. Each further candidate is scored by the least it added to any feature chosen so far,
    measured in baseline deviations; ties go to the larger name.
    """
    n, p = g[-1, -1], len(names)
    if n < 2:
        return []
    deviation = lambda sse: float(np.sqrt(max(sse, 0.0) / n))
    base = [deviation(g[y, y]) for y in ys]
    alone = {i: [deviation(_residual(g, [columns[i][t]], y)) for t, y in enumerate(ys)] for i in range(p)}
    score = {i: float(np.mean([b - a for b, a in zip(base, alone[i])])) for i in range(p)}
    left = [i for i in score if score[i] > 0 and score[i] >= LEAST_GAIN]
    chosen: list[tuple[int, float]] = []
    while left and len(chosen) < most:
        best = max(left, key=lambda i: (score[i], names[i]))
        chosen.append((best, score[best]))
        left.remove(best)
        mean_base = float(np.mean(base))
        for i in left:
            gain = 0.0 if mean_base <= 1e-12 else float(np.mean([(a - deviation(_residual(g, [columns[i][t], columns[best][t]], y))) / mean_base for t, (a, y) in enumerate(zip(alone[best], ys))]))
            score[i] = min(score[i], gain)
        left = [i for i in left if score[i] >= LEAST_GAIN]
    return [(names[i], s) for i, s in chosen]


def pairwise_select(df: DataFrame, features: dict[str, Column | list[Column]], targets: list[tuple[str, Column]], most: int = 10) -> DataFrame:
    """(rank, feature, score) of the chosen features; impute before, as rows with any missing value are left out.

    A feature is one column, or a list with one for each target, such as a category encoded by class.
    """
    flat: list[Column] = []
    columns = []
    for c in features.values():
        own = c if isinstance(c, list) else [c]
        places = list(range(len(flat), len(flat) + len(own)))
        columns.append(places if isinstance(c, list) else places * len(targets))
        flat += own
    g = gram_matrix(df, [*flat, *(t for _, t in targets)])
    rows = [(i + 1, n, s) for i, (n, s) in enumerate(greedy_choice(g, list(features), columns, list(range(len(flat), len(flat) + len(targets))), most))]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, score double")


class LinearSelector:
    """``pairwise_select`` over filled and encoded columns."""

    def select(self, df: DataFrame, numbers: dict[str, Column | list[Column]], target: str, targets: list[tuple[str, Column]], most: int) -> DataFrame:
        return pairwise_select(df, numbers, targets, most)


class TreeSelector:
    """``tree_select`` over the same columns; a category counts as the sum of its columns' importances."""

    def __init__(self, trees: int = 20, refit: bool = True) -> None:
        self.trees, self.refit = trees, refit

    def select(self, df: DataFrame, numbers: dict[str, Column | list[Column]], target: str, targets: list[tuple[str, Column]], most: int) -> DataFrame:
        flat = {(n, i): c for n, cs in numbers.items() for i, c in enumerate(cs if isinstance(cs, list) else [cs])}
        wide = df.select(F.col(target), *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(flat.values())))
        found = {r["feature"]: r["importance"] for r in tree_select(wide, [f"_x{i}" for i in range(len(flat))], target, len(flat), self.trees).collect()}
        sums: dict[str, float] = {}
        for i, (n, _) in enumerate(flat):
            sums[n] = sums.get(n, 0.0) + found.get(f"_x{i}", 0.0)
        kept = sorted((x for x in sums.items() if x[1] > 0), key=lambda x: (-x[1], x[0]))[:most]
        if self.refit and 0 < len(kept) < len(sums):
            # once more with the chosen ones only, so that the importances are theirs
            return TreeSelector(self.trees, refit=False).select(df, {n: numbers[n] for n, _ in kept}, target, targets, most)
        return df.sparkSession.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(kept)], "rank int, feature string, score double")


SELECTORS = {"linear": LinearSelector, "tree": TreeSelector}


def tree_select(df: DataFrame, features: list[str], target: str, most: int = 10, trees: int = 20, seed: int = 42) -> DataFrame:
    """(rank, feature, importance) by the gain of boosted trees, or of a forest for classes. Few rows get shallower trees."""
    clean = df.where(F.col(target).isNotNull())
    regression = isinstance(clean.schema[target].dataType, (T.FloatType, T.DoubleType))
    depth = int(min(6, max(2, np.log2(max(clean.count(), 2)) // 3)))
    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(clean.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(target).alias("_t")))
    if regression:
        model = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=min(depth, 4), seed=seed).fit(ready.withColumn("_y", F.col("_t").cast("double")))
    else:
        indexed = StringIndexer(inputCol="_t", outputCol="_y").fit(ready.withColumn("_t", F.col("_t").cast("string"))).transform(ready.withColumn("_t", F.col("_t").cast("string")))
        model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(indexed)
    ranked = sorted(zip(features, map(float, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))[:most]
    return df.sparkSession.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(ranked)], "rank int, feature string, importance double")
