"""Candidate features from a table's own columns, types of text answers, and the checks a feature must pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.text import FALSE_WORDS, TRUE_WORDS, as_number
from driftloom.operators.features import OTHER, Feature, enrich
from driftloom.session import cut_lineage
from driftloom.types import is_enum, is_nested, is_temporal


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, missing, distinct): one aggregate over all columns; null counts as a value."""
    ks = [f"`{c}`" for c in columns]
    row = df.agg(F.count("*").alias("rows"), *(x for i, k in enumerate(ks) for x in (F.count_if(F.col(k).isNull()).alias(f"m{i}"), F.count_distinct(F.col(k)).alias(f"d{i}"))))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), (F.col(f"d{i}") + (F.col(f"m{i}") > 0).cast("int")).alias("distinct")) for i, c in enumerate(columns))))
    return row.select("rows", each.alias("p")).select("p.column", "rows", "p.missing", "p.distinct")


def top_categories(df: DataFrame, column: str, most: int = 9) -> DataFrame:
    """(value, n, rows) of the most frequent values, ties by value; null and '' are no categories but count as rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("rows"))
    return counts.where("value IS NOT NULL AND value <> ''").orderBy(F.desc("n"), "value").limit(most).join(F.broadcast(total), F.lit(True))


def original_columns(df: DataFrame, target: str, most_categories: int = 9, least_coverage: float = 0.5) -> list[Feature]:
    """A feature for each column but the target, dates, nested and constant ones; text only if its top values cover enough."""
    usable = [f for f in df.schema.fields if f.name != target and not is_temporal(f.dataType) and not is_nested(f.dataType)]
    distinct = {r["column"]: r["distinct"] for r in profile(df, [f.name for f in usable]).collect()} if usable else {}
    out = []
    for f in usable:
        if distinct[f.name] <= 1:
            continue
        column = f"`{f.name}`"
        if isinstance(f.dataType, T.BooleanType):
            out.append(Feature(f.name, "bool", column, default_missing=False))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(Feature(f.name, "float", column))
        elif isinstance(f.dataType, (T.IntegralType, T.DecimalType)):
            out.append(Feature(f.name, "int", column, default_missing=0))
        elif is_enum(f):
            out.append(Feature(f.name, "category", column, categories=tuple(f.metadata["enum"]), default_missing=OTHER))
        elif isinstance(f.dataType, T.StringType):
            top = top_categories(df, f.name, most_categories).collect()
            if top and sum(r["n"] for r in top) / top[0]["rows"] >= least_coverage:
                out.append(Feature(f.name, "category", column, categories=tuple(r["value"] for r in top), default_missing=OTHER))
    return out


@dataclass(frozen=True)
class Generated:
    """A candidate; ``has_good_defaults``: its defaults need no estimate from the data."""

    feature: Feature
    has_good_defaults: bool = False


class OriginalColumns:
    """Generates ``original_columns``. Any object with such a ``generate`` is a generator."""

    def generate(self, search: DataFrame, target: str, key: str, tables: dict[str, DataFrame]) -> Iterator[Generated]:
        for f in original_columns(search, target):
            if f.name != key:
                yield Generated(f, f.kind in ("bool", "category"))


class GivenFeatures:
    def __init__(self, features: Sequence[Feature]) -> None:
        self.features = features

    def generate(self, search: DataFrame, target: str, key: str, tables: dict[str, DataFrame]) -> Iterator[Generated]:
        yield from (Generated(f) for f in self.features)


def infer_kinds(df: DataFrame, columns: list[str], errors: float = 0.05, most: int = 9, least_share: float = 0.01, least_coverage: float = 0.9, longest: int = 50) -> DataFrame:
    """(column, kind, categories): what text columns hold: bool, int, float, category or str, the first that fits.

    All columns in long form: one aggregate by column and value, then one by column.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)))
    counts = df.select(pairs.alias("p")).select("p.column", "p.value").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n")
    sum_if = lambda c: F.sum(F.when(c, n).otherwise(0))
    base = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), sum_if(F.lower(v).isin(*TRUE_WORDS, *FALSE_WORDS)).alias("bools"),
        sum_if(as_number(v, "bigint").isNotNull()).alias("ints"), sum_if(as_number(v, "double").isNotNull()).alias("floats"),
    )
    often = counts.join(F.broadcast(base.select("column", "rows")), "column").where(n >= F.floor(F.col("rows") * least_share))
    top = often.groupBy("column").agg(F.slice(F.sort_array(F.collect_list(F.struct((-n).alias("m"), "value"))), 1, most).alias("top"))  # at most 1/least_share values
    both = base.join(F.broadcast(top), "column", "left")
    covered = F.aggregate("top", F.lit(0).cast("bigint"), lambda a, x: a - x["m"]) / F.col("rows")
    plain = ~F.exists("top", lambda x: (x["value"] == "") | (F.length(x["value"]) > longest))
    kind = (
        F.when(F.col("bools") >= F.col("rows") * (1 - errors), "bool").when(F.col("rows") - F.col("ints") <= F.col("rows") * errors, "int")
        .when(F.col("rows") - F.col("floats") <= F.col("rows") * errors, "float").when(plain & (covered >= least_coverage), "category").otherwise("str")
    )
    return both.select("column", kind.alias("kind"), F.when(kind == "category", F.sort_array(F.transform("top", lambda x: x["value"]))).alias("categories"))


def empty_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, empty_share): null or ''."""
    row = df.agg(*(F.avg((F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == "")).cast("int")).alias(f"e{i}") for i, c in enumerate(columns)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"e{i}").alias("empty_share")) for i, c in enumerate(columns)))).alias("p")).select("p.*")


@dataclass(frozen=True)
class Finding:
    law: str
    detail: str


def law_and_order(df: DataFrame, feature: Feature, key: str, tables: dict[str, DataFrame] | None = None, longest: int = 50, rows_alone: int = 5) -> list[Finding]:
    """The laws a feature breaks: same result again (consistent), in another order and layout of the rows (order), for a row by itself as
    for all (batch), not one single value (constant), no overlong categories (length), no columns or tables it didn't declare (access).
    """
    found = []
    value = lambda d: enrich(d, [feature], key, [key], tables)
    declared = feature.params or tuple(df.columns)
    try:
        enrich(df.select(*dict.fromkeys([key, *declared])), [feature], key, [key], {t: d for t, d in (tables or {}).items() if not feature.tables or t in feature.tables}).schema  # noqa: B018
    except Exception as e:  # noqa: BLE001
        return [Finding("access", str(e).splitlines()[0][:200])]
    first = cut_lineage(value(df))
    name = next(c for c in first.columns if c != key)
    # the rows dealt out by another key, so that batches and partitions hold other rows in another order
    shuffled = df.repartition(7, F.xxhash64(F.col(key), F.lit(1))).sortWithinPartitions(F.xxhash64(F.col(key), F.lit(2)))
    tries = [("consistent", value(df)), ("order", value(shuffled))]
    if feature.query is None:
        few = df.orderBy(F.xxhash64(F.col(key), F.lit(3))).limit(rows_alone)
        tries.append(("batch", reduce(DataFrame.unionByName, (value(few.where(F.col(key) == k)) for k in [r[key] for r in few.select(key).collect()]), value(few.limit(0)))))
    for law, other in tries:
        pair = first.alias("a").join(other.alias("b"), key)
        if pair.where(~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))).limit(1).count():
            found.append(Finding(law, "values differ"))
    if first.select(name).distinct().limit(2).count() < 2:
        found.append(Finding("constant", "one value only"))
    if feature.kind == "category" and any(len(c) > longest for c in feature.categories):
        found.append(Finding("length", f"a category is longer than {longest}"))
    return found


@dataclass
class Budget:
    """Tries that several features share."""

    left: int

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def retry_until_valid(make: Callable[[list[Finding]], Feature | None], check: Callable[[Feature], list[Finding]], tries: int = 3, budget: Budget | None = None) -> tuple[Feature | None, list[list[Finding]]]:
    """Lets ``make`` correct a feature by what it broke, up to ``tries`` times and as long as the shared budget lasts. All findings are returned too."""
    history: list[list[Finding]] = []
    for _ in range(tries):
        if budget is not None and not budget.take():
            break
        feature = make(history[-1] if history else [])
        if feature is None:
            return None, history
        findings = check(feature)
        if not findings:
            return feature, history
        history.append(findings)
    return None, history
