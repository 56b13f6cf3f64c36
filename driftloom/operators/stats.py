"""Statistics of features and of their relation to a target.

All of it is aggregates: many features are turned into long form once and aggregated by feature, so the number of jobs does
not grow with the number of features. Dense grids are built from the labels seen, which are few by construction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.hashing import portable_hash
from driftloom.operators.quantiles import exact_quantiles, rank_averages
from driftloom.session import prefix_sums

INF = float("inf")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def support(df: DataFrame, column: str) -> DataFrame:
    """(value, n, support): the share of each value among the non-null ones."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total), F.lit(True)).select("value", "n", (F.col("n") / F.col("_all")).alias("support"))


def quantile_edges(df: DataFrame, column: str, bins: int = 5, group: list[str] | None = None) -> DataFrame:
    """(group…, edges): ``bins - 1`` inner edges between the infinities, with repeats where values are tied."""
    q = exact_quantiles(df, group or [], column, [i / bins for i in range(1, bins)])
    return q.select(*(group or []), F.concat(F.array(F.lit(-INF)), "quantiles", F.array(F.lit(INF))).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Index from 0 of the right-closed bin among the distinct edges; null for null and NaN."""
    inner = F.array_distinct(edges)
    below = F.size(F.filter(inner, lambda e: e < value))
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(below - 1, F.lit(0)))


def quantile_binned(df: DataFrame, column: str, out: str, bins: int = 5) -> DataFrame:
    edges = quantile_edges(df, column, bins)
    return df.join(F.broadcast(edges), F.lit(True), "left").withColumn(out, bin_of(F.col(column).cast("double"), F.col("edges"))).drop("edges")


def confusion(df: DataFrame, feature: Column, target: Column) -> DataFrame:
    """(category, class, n): every category with every class, zeros included; rows without either are left out."""
    counts = df.select(feature.cast("string").alias("category"), target.cast("string").alias("class")).where("category IS NOT NULL AND class IS NOT NULL")
    counts = counts.groupBy("category", "class").agg(F.count("*").alias("n"))
    classes = counts.agg(F.sort_array(F.collect_set("class")).alias("_classes"))  # classes of a problem are few
    grid = counts.select("category").distinct().join(F.broadcast(classes), F.lit(True)).select("category", F.explode("_classes").alias("class"))
    return grid.join(counts, ["category", "class"], "left").select("category", "class", F.coalesce("n", F.lit(0)).alias("n"))


def lift_and_shift(grid: DataFrame, group: list[str] | None = None) -> DataFrame:
    """A grid of counts with lift = P(class|category)/P(class) and mean_shift = P(class|category) - P(class)."""
    g = group or []
    total = F.sum("n").over(W.partitionBy(*g))
    p = F.try_divide(F.sum("n").over(W.partitionBy(*g, "class")), total)
    given = F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(*g, "category")))
    return grid.withColumn("lift", F.try_divide(given, p)).withColumn("mean_shift", given - p)


def missing_per_class(df: DataFrame, feature: str, target: str) -> DataFrame:
    """(class, total, missing, missing_share): null only, NaN isn't missing."""
    own = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class"))
    return own.agg(F.count("*").alias("total"), F.count_if(F.col(feature).isNull()).alias("missing")).withColumn("missing_share", F.try_divide("missing", "total"))


def finite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, finite, pos_inf, neg_inf, nan, missing) of numeric columns."""
    long = to_long(df, {c: F.col(c).cast("double") for c in columns}, [])
    v = F.col("value")
    return long.groupBy("feature").agg(
        F.count_if(finite(v)).alias("finite"), F.count_if(v == INF).alias("pos_inf"), F.count_if(v == -INF).alias("neg_inf"),
        F.count_if(F.isnan(v)).alias("nan"), F.count_if(v.isNull()).alias("missing"),
    )


def to_long(df: DataFrame, features: dict[str, Column], keep: list[str]) -> DataFrame:
    """(keep…, feature, value): one row per row and feature."""
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in features.items()))
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")


def histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(feature, bin, low, high, n): equal widths over the finite values; the outer bins also hold the infinities."""
    long = to_long(df, {c: F.col(c).cast("double") for c in columns}, []).where("value IS NOT NULL AND NOT isnan(value)")
    v = F.col("value")
    ends = long.where(finite(v)).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(v == INF, bins - 1).when((v == -INF) | (width == 0), 0).otherwise(F.least(F.floor((v - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counts = long.join(F.broadcast(ends), "feature").groupBy("feature", at.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("feature", "lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    low = F.when(F.col("bin") == 0, -INF).otherwise(F.col("lo") + F.col("bin") * F.col("w"))
    high = F.when(F.col("bin") == bins - 1, INF).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("w"))
    return grid.join(counts, ["feature", "bin"], "left").select("feature", "bin", low.alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def encoded_targets(df: DataFrame, target: str) -> list[tuple[str, Column]]:
    """(name, 0/1 or numeric column) of a target: floats as they are, two classes as one indicator, more as one each."""
    if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)):
        return [(target, F.col(target).cast("double"))]
    classes = sorted(r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().limit(1001).collect())
    if len(classes) > 1000:
        raise ValueError(f"{target} has too many classes")
    if len(classes) == 2:
        return [(str(classes[1]), (F.col(target) == F.lit(classes[1])).cast("double"))]
    return [(str(c), (F.col(target) == F.lit(c)).cast("double")) for c in classes]


def explained(df: DataFrame, features: dict[str, Column | list[Column]], targets: list[tuple[str, Column]]) -> DataFrame:
    """(feature, n, sse_reduction, r_squared) of one-variable least squares, averaged over the targets.

    sse_reduction is the fall of the residual standard deviation. Centred sums (regr_*) keep it stable at any magnitude; rows
    with a null or non-finite value of the feature are left out for that feature; fewer than two rows give nulls. A feature is one
    column, or a list with one for each target.
    """
    own = {n: c if isinstance(c, list) else [c] * len(targets) for n, c in features.items()}
    value = lambda cs: F.struct(*(c.cast("double").alias(f"v{i}") for i, c in enumerate(cs)))
    wide = df.select(*(t.alias(f"_t{i}") for i, (_, t) in enumerate(targets)), *(value(cs).alias(f"_f{i}") for i, cs in enumerate(own.values())))
    long = to_long(wide, {n: F.col(f"_f{i}") for i, n in enumerate(own)}, [f"_t{i}" for i in range(len(targets))])
    ok = reduce(lambda a, b: a & b, (F.col(f"_t{i}").isNotNull() & finite(F.col(f"value.v{i}")) for i in range(len(targets))))
    sums = long.where(ok).groupBy("feature").agg(
        F.count("*").alias("n"),
        *(f(F.col(f"_t{i}"), F.col(f"value.v{i}")).alias(f"{n}{i}") for i in range(len(targets)) for n, f in (("sxx", F.regr_sxx), ("syy", F.regr_syy), ("sxy", F.regr_sxy))),
    )
    drops, r2 = [], []
    for i in range(len(targets)):
        syy, gain = F.col(f"syy{i}"), F.coalesce(F.try_divide(F.col(f"sxy{i}") * F.col(f"sxy{i}"), F.col(f"sxx{i}")), F.lit(0.0))
        drops.append(F.sqrt(syy / F.col("n")) - F.sqrt(F.greatest((syy - gain) / F.col("n"), F.lit(0.0))))
        r2.append(F.least(F.greatest(F.coalesce(F.try_divide(gain, syy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    mean = lambda xs: reduce(lambda a, b: a + b, xs) / len(xs)
    enough = F.col("n") > 1
    return sums.select("feature", "n", F.when(enough, mean(drops)).alias("sse_reduction"), F.when(enough, mean(r2)).alias("r_squared"))


def ordered_encodings(df: DataFrame, key: str, categories: list[str], targets: list[Column], permutations: int = 5, prior: float = 5.0) -> DataFrame:
    """(key, encoded: feature → an encoding for each target) of several categories at once: ``ordered_target_stats`` of all of them, each by
    every target, in one pass of running sums over (category, value, order).
    """
    ys = [f"_y{i}" for i in range(len(targets))]
    rows = df.select(F.col(key), *(F.col(f"`{c}`").cast("string").alias(f"_c{i}") for i, c in enumerate(categories)), *(t.cast("double").alias(y) for t, y in zip(targets, ys))).dropna(subset=ys)
    means = rows.agg(*(F.avg(y).alias(f"_m{y}") for y in ys))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("value")) for i, c in enumerate(categories))))
    order = reduce(lambda a, p: F.when(F.col("_p") == p, portable_hash(F.col(key), p)).otherwise(a), range(permutations), F.lit(None).cast("bigint"))
    long = rows.withColumn("_f", each).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumns({"_h": order, "_one": F.lit(1), "_feature": F.col("_f.feature"), "_value": F.col("_f.value")}).drop("_f").where("_value IS NOT NULL")
    done = prefix_sums(long, ["_feature", "_value", "_p"], "_h", [*ys, "_one"], [f"_s{y}" for y in ys] + ["_n"], F.shiftright("_h", 48), [key]).join(F.broadcast(means), F.lit(True))
    mean = done.groupBy(key, "_feature").agg(F.array(*(F.avg((F.col(f"_s{y}") + prior * F.col(f"_m{y}")) / (F.col("_n") + prior)) for y in ys)).alias("_e"))
    return mean.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_feature", "_e"))).alias("encoded"))


def ordered_target_stats(df: DataFrame, key: str, category: str, target: Column, permutations: int = 5, prior: float = 5.0) -> DataFrame:
    """(key, encoded): each row's category as the mean target of earlier rows of that category, over several hash orders.

    Running sums are taken in buckets of the hash, so a category of any size is safe.
    """
    rows = df.where(F.col(category).isNotNull()).select(key, category, target.cast("double").alias("_y")).where("_y IS NOT NULL")
    mean = rows.agg(F.avg("_y").alias("_mean"))
    each = rows.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    order = reduce(lambda a, p: F.when(F.col("_p") == p, portable_hash(F.col(key), p)).otherwise(a), range(permutations), F.lit(None).cast("bigint"))
    each = each.withColumn("_h", order).withColumn("_one", F.lit(1)).withColumn("_b", F.shiftright("_h", 48))
    done = prefix_sums(each, [category, "_p"], "_h", ["_y", "_one"], ["_sum", "_n"], F.col("_b"), [key])
    value = (F.col("_sum") + prior * F.col("_mean")) / (F.col("_n") + prior)
    return done.join(F.broadcast(mean), F.lit(True)).groupBy(key).agg(F.avg(value).alias("encoded"))


def correlations(df: DataFrame, feature: str, target: str) -> DataFrame:
    """One row (n, pearson, spearman) over rows with a finite feature and a target; tied ranks are averaged."""
    own = df.select(F.col(feature).cast("double").alias("x"), F.col(target).cast("double").alias("y")).where(finite(F.col("x")) & F.col("y").isNotNull())
    # ties are counted before the joins, so a value that half the rows have is a few rows there
    pairs = own.groupBy("x", "y").agg(F.count("*").cast("double").alias("c"))
    ranked = pairs.join(rank_averages(own, "x", "rx"), "x").join(rank_averages(own, "y", "ry"), "y")
    whole = own.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"))
    a, b = (F.col(r) - (F.col("n") + 1) / 2 for r in ("rx", "ry"))  # ranks around their mean
    sums = ranked.join(F.broadcast(whole), F.lit(True)).agg(F.sum(F.col("c") * a * b).alias("ab"), F.sum(F.col("c") * a * a).alias("aa"), F.sum(F.col("c") * b * b).alias("bb"))
    return whole.join(F.broadcast(sums), F.lit(True)).select("n", "pearson", F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("spearman"))


def defaults(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(feature, kind, missing, nan, pos_inf, neg_inf): what stands in for values that aren't there.

    ``columns``: kind of each, ``int`` or ``float``. Floats: infinities become max + 1 and min - 1 of the finite values,
    missing and NaN the median after that; ints: the median, truncated. Without values -1, 0, 1 and 0.
    """
    long = to_long(df, {c: F.col(c).cast("double") for c in columns}, [])
    v = F.col("value")
    kinds = F.create_map(*(x for c, k in columns.items() for x in (F.lit(c), F.lit(k))))
    ends = long.groupBy("feature").agg((F.max(F.when(finite(v), v)) + 1).alias("hi"), (F.min(F.when(finite(v), v)) - 1).alias("lo"))
    filled = long.join(F.broadcast(ends), "feature").select("feature", F.when(v == INF, F.col("hi")).when(v == -INF, F.col("lo")).otherwise(v).alias("value"))
    medians = exact_quantiles(filled, ["feature"], "value", [0.5]).select("feature", F.col("quantiles")[0].alias("median"))
    both = ends.join(F.broadcast(medians), "feature", "left").withColumn("kind", kinds[F.col("feature")])
    middle = F.coalesce(F.when(F.col("kind") == "int", F.col("median").cast("bigint").cast("double")).otherwise(F.col("median")), F.lit(0.0))
    real = F.col("kind") == "float"
    return both.select("feature", "kind", middle.alias("missing"), F.when(real, middle).alias("nan"), F.when(real, F.coalesce("hi", F.lit(1.0))).alias("pos_inf"), F.when(real, F.coalesce("lo", F.lit(-1.0))).alias("neg_inf"))


def defined_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, defined): rows that are neither null nor NaN."""
    return to_long(df, {c: F.col(c).cast("double") for c in columns}, []).groupBy("feature").agg(F.count_if(F.col("value").isNotNull() & ~F.isnan("value")).alias("defined"))


def category_view(df: DataFrame, features: list[str], keep: list[str], bins: int = 5) -> DataFrame:
    """(keep…, feature, category): strings as they are, booleans as True/False, numbers as the index of their quantile bin."""
    kinds = {f: df.schema[f].dataType for f in features}
    numbers = [f for f, k in kinds.items() if isinstance(k, T.NumericType)]
    others = {f: F.when(F.col(f), "True").when(~F.col(f), "False") if isinstance(k, T.BooleanType) else F.col(f).cast("string") for f, k in kinds.items() if f not in numbers}
    parts = []
    if others:
        parts.append(to_long(df, others, keep).withColumnRenamed("value", "category"))
    if numbers:
        long = to_long(df, {f: F.col(f).cast("double") for f in numbers}, keep)
        edges = quantile_edges(long.select("feature", "value"), "value", bins, ["feature"])  # a row per feature
        parts.append(long.join(F.broadcast(edges), "feature", "left").select(*keep, "feature", bin_of(F.col("value"), F.col("edges")).cast("string").alias("category")))
    return reduce(DataFrame.unionByName, parts)


def class_view(df: DataFrame, target: str, bins: int = 5) -> DataFrame:
    """``df`` with ``_class``: the class as text, or the quantile bin of a float target."""
    if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)):
        return quantile_binned(df, target, "_class", bins).withColumn("_class", F.col("_class").cast("string"))
    return df.withColumn("_class", F.col(target).cast("string"))


def feature_stats(df: DataFrame, features: list[str], bins: int = 5) -> DataFrame:
    """(feature, category, n, support, missing_share) of all features in one aggregation."""
    long = category_view(df, features, [], bins)
    counts = long.groupBy("feature", "category").agg(F.count("*").alias("n"))
    of_all, defined = F.sum("n").over(W.partitionBy("feature")), F.sum(F.when(F.col("category").isNotNull(), F.col("n"))).over(W.partitionBy("feature"))
    empty = F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("n"))).over(W.partitionBy("feature")), F.lit(0))
    return counts.withColumn("support", F.try_divide("n", defined)).withColumn("missing_share", empty / of_all).where("category IS NOT NULL")


def relationship_stats(df: DataFrame, features: list[str], target: str, bins: int = 5) -> DataFrame:
    """(feature, category, class, n, lift, mean_shift) of all features in one aggregation, zeros included."""
    long = category_view(class_view(df, target, bins), features, ["_class"], bins).where("category IS NOT NULL AND _class IS NOT NULL")
    counts = long.groupBy("feature", "category", F.col("_class").alias("class")).agg(F.count("*").alias("n"))
    labels = counts.groupBy("feature").agg(F.collect_set("class").alias("_classes"))
    grid = counts.select("feature", "category").distinct().join(F.broadcast(labels), "feature").select("feature", "category", F.explode("_classes").alias("class"))
    dense = grid.join(counts, ["feature", "category", "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return lift_and_shift(dense, ["feature"])


def numeric_summary(df: DataFrame, columns: list[str], target: str | None = None, bins: int = 10) -> dict[str, DataFrame]:
    """What is told about numbers beyond categories: ``counts`` of finite and other values, ``histogram``, and for a numeric target
    ``correlations`` (feature, n, pearson, spearman).
    """
    out = {"counts": finite_counts(df, columns), "histogram": histogram(df, columns, bins)}
    if target is not None:
        out["correlations"] = reduce(DataFrame.unionByName, (correlations(df, c, target).select(F.lit(c).alias("feature"), "*") for c in columns))
    return out


def in_class_order(relations: DataFrame, classes: list) -> DataFrame:
    """``relationship_stats`` with ``class_no``: the problem's classes in their order, then others seen, by name."""
    known = [str(c) for c in classes]
    place = F.coalesce(*(F.when(F.col("class") == c, F.lit(i)) for i, c in enumerate(known))) if known else F.lit(None).cast("int")
    extra = relations.where(~F.col("class").isin(known)).select("class").distinct().withColumn("_no", len(known) + F.row_number().over(W.orderBy("class")) - 1)  # classes are few
    return relations.join(F.broadcast(extra), "class", "left").withColumn("class_no", F.coalesce(place, F.col("_no")).cast("int")).drop("_no")
