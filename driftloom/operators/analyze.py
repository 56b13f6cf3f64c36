"""From a table with a target to the features that drive it: discover the problem, generate, enrich, choose, describe."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators import select, split, stats
from driftloom.operators.features import COMPUTERS, OTHER, Feature, enrich
from driftloom.functions.text import unique_names
from driftloom.operators.generate import Generated, GivenFeatures, OriginalColumns
from driftloom.progress import stage
from driftloom.session import cut_lineage
from driftloom.types import is_temporal


@dataclass(frozen=True)
class Problem:
    """``kind``: classification (with its sorted classes) or regression."""

    target: str
    kind: str
    classes: tuple = ()
    desired: Any = None
    date_column: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("classification", "regression") or self.kind == "regression" and (self.classes or self.desired not in (None, "up", "down")):
            raise ValueError("a classification has classes, a regression a direction at most")
        if self.kind == "classification" and (len(self.classes) < 2 or list(self.classes) != sorted(self.classes)):
            raise ValueError("a classification needs at least two classes, in order")
        if self.kind == "classification" and self.desired is not None and self.desired not in self.classes:
            raise ValueError(f"{self.desired!r} is none of the classes")

    def to_dict(self) -> dict:
        return {"type": "problem", **asdict(self)}

    @staticmethod
    def from_dict(d: dict) -> "Problem":
        return Problem(**{k: tuple(v) if k == "classes" else v for k, v in d.items() if k != "type"})


def discover_problem(df: DataFrame, target: str, kind: str | None = None, desired: Any = None, date_column: str | None = None, max_classes: int = 20) -> Problem:
    """Integers, booleans and strings are classes unless ``desired`` is a direction (up or down); floats are regressed."""
    if target not in df.columns:
        raise ValueError(f"no target column {target}")
    if date_column is not None and not is_temporal(df.schema[date_column].dataType):
        raise ValueError(f"{date_column} isn't a date or time")
    dtype, directed = df.schema[target].dataType, desired in ("up", "down")
    if kind is None:
        kind = "classification" if isinstance(dtype, (T.IntegralType, T.BooleanType, T.StringType)) and not directed else "regression"
    if kind == "regression":
        if not isinstance(dtype, T.NumericType):
            raise ValueError("a regression target must be a number")
        return Problem(target, kind, (), desired, date_column)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        raise ValueError("a float target can't be classified")
    return Problem(target, kind, classes_of(df, target, max_classes), desired, date_column)


def classes_of(df: DataFrame, target: str, max_classes: int = 20) -> tuple:
    """The classes of a target in order: the declared ones of an enum, else those seen."""
    classes = df.schema[target].metadata.get("enum") or [r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().limit(max_classes + 1).collect()]
    if len(classes) > max_classes:
        raise ValueError(f"{target} has more than {max_classes} classes")
    return tuple(sorted(classes))


def target_violations(df: DataFrame, target: str) -> DataFrame:
    """(rows, missing, not_finite) of a target."""
    v = F.col(target)
    bad = F.isnan(v) | (F.abs(v) == float("inf")) if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)) else F.lit(False)
    return df.agg(F.count("*").alias("rows"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.coalesce(bad, F.lit(False))).alias("not_finite"))


@dataclass(frozen=True)
class Described:
    """Statistics of the chosen features on one split: of the features, of their relation to the target, variance explained, and of numbers."""

    stats: DataFrame
    relations: DataFrame
    explained: DataFrame
    numbers: dict[str, DataFrame]


@dataclass(frozen=True)
class Analysis:
    problem: Problem
    features: tuple[Feature, ...]
    chosen: DataFrame
    train: Described
    test: Described

    @property
    def stats(self) -> DataFrame:
        return self.train.stats

    @property
    def relations(self) -> DataFrame:
        return self.train.relations

    @property
    def explained(self) -> DataFrame:
        return self.train.explained


def check_splits(parts: dict[str, DataFrame]) -> None:
    """Train, test, search and evaluation rows must have the same schema."""
    kinds = {n: [(f.name, f.dataType) for f in d.schema.fields] for n, d in parts.items()}
    first = next(iter(kinds.values()))
    if other := [n for n, k in kinds.items() if k != first]:
        raise ValueError(f"other schemas: {other}")


def table_name(name: str | None, prefix: str = "enriched") -> str:
    """A given name, or one that no other table has."""
    return name if name else f"{prefix}_{uuid.uuid4().hex[:12]}"


def numbered(df: DataFrame, key: str, features: Sequence[Feature], targets: list[tuple[str, Any]]) -> tuple[DataFrame, dict[str, Any]]:
    """``df`` with its features as numbers: those that are stay, categories are encoded once for each target."""
    numbers: dict[str, Any] = {f.name: F.col(f"`{f.name}`").cast("double") for f in features if f.kind != "category"}
    categories = [f.name for f in features if f.kind == "category"]
    if categories:
        df = df.join(stats.ordered_encodings(df, key, categories, [t for _, t in targets]).withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left").drop("_k")
        numbers |= {c: [F.element_at(F.col("encoded")[c], i + 1) for i in range(len(targets))] for c in categories}
    return df, numbers


def describe(df: DataFrame, key: str, target: str, features: Sequence[Feature], problem: Problem) -> Described:
    """Statistics of raw feature values in ``df`` (key, target, features) and of their filled values against the target."""
    names = [f.name for f in features]
    filled = df.select(key, target, *(f.with_defaults(F.col(f"`{f.name}`")).alias(f.name) for f in features))
    targets = stats.encoded_targets(filled, target)
    ready, numbers = numbered(filled, key, features, targets)
    relations = stats.relationship_stats(df, names, target)
    relations = stats.in_class_order(relations, list(problem.classes)) if problem.kind == "classification" else relations
    numeric = [f.name for f in features if f.kind in ("int", "float")]
    found = stats.numeric_summary(df, numeric, target if problem.kind == "regression" else None) if numeric else {}
    return Described(stats.feature_stats(df, names), relations, stats.explained(ready, numbers, targets), found)


def filled_features(enriched: DataFrame, candidates: Sequence[Generated], least_defined: int) -> list[Feature]:
    """The candidates with enough defined values, with their defaults; estimated from the data where they have no good ones."""
    features = [g.feature for g in candidates]
    numeric = [f for f in features if f.kind in ("int", "float")]
    defined = {r["feature"]: r["defined"] for r in stats.defined_counts(enriched, [f.name for f in numeric]).collect()} if numeric else {}
    others = [f.name for f in features if f.kind not in ("int", "float")]
    if others:
        defined |= enriched.agg(*(F.count(F.col(f"`{n}`")).alias(n) for n in others)).first().asDict()
    kept = [g for g in candidates if defined[g.feature.name] >= least_defined]
    open_ones = {g.feature.name: g.feature.kind for g in kept if not g.has_good_defaults and g.feature.kind in ("int", "float")}
    fills = {r["feature"]: r for r in stats.defaults(enriched, open_ones).collect()} if open_ones else {}
    out = []
    for g in kept:
        f = g.feature
        if f.name in fills:
            r = fills[f.name]
            f = replace(f, default_missing=int(r["missing"]) if f.kind == "int" else r["missing"], default_nan=r["nan"], default_inf=r["pos_inf"], default_neg_inf=r["neg_inf"])
        elif f.default_missing is None:
            f = replace(f, default_missing=False if f.kind == "bool" else OTHER)
        out.append(f)
    return out


def analyze(df: DataFrame, key: str, target: str, features: Sequence[Feature] | None = None, tables: dict[str, DataFrame] | None = None, most: int = 10, least_defined: int = 30, train_fraction: float = 0.8, search_rows: int = 10_000, eval_rows: int = 100_000, generators: Sequence[Any] | None = None, selector: Any = "linear", computers: Sequence[Any] = COMPUTERS) -> Analysis:
    """The whole run. Candidates come from generators looking at the search rows; they are computed, filled and chosen (by the selector
    ``linear`` or ``tree``, or an object with ``select``) on the evaluation rows. The chosen ones are described on all training and on
    all test rows.
    """
    flagged = split.split(df, key, train_fraction, search_rows, eval_rows)
    parts = {n: split.part(flagged, n) for n in ("feature_search", "feature_eval", "train", "test")}
    check_splits(parts)
    problem = discover_problem(parts["train"], target)
    for name in ("train", "test"):
        bad = target_violations(parts[name], target).first()
        if bad["missing"] or bad["not_finite"]:
            raise ValueError(f"{bad['missing']} missing and {bad['not_finite']} non-finite targets in {name}")
    made = generators or [GivenFeatures(features) if features is not None else OriginalColumns()]
    candidates = [g for x in made for g in x.generate(parts["feature_search"], target, key, tables or {})]
    names = unique_names([g.feature.name for g in candidates], {key, target})
    raw = [replace(g.feature, name=n) for g, n in zip(candidates, names)]
    candidates = [replace(g, feature=f) for g, f in zip(candidates, raw)]
    with stage("enrich"):
        enriched = cut_lineage(enrich(parts["feature_eval"], raw, key, [key, target], tables, computers=computers))
    filled = filled_features(enriched, candidates, least_defined)
    ready = enriched.select(key, target, *(f.with_defaults(F.col(f"`{f.name}`")).alias(f.name) for f in filled))
    targets = stats.encoded_targets(ready, target)
    ready, numbers = numbered(ready, key, filled, targets)
    chooser = select.SELECTORS[selector]() if isinstance(selector, str) else selector
    with stage("select", len(numbers)):
        chosen = chooser.select(ready, numbers, target, targets, most)
    order = [r["feature"] for r in chosen.orderBy("rank").collect()]
    kept = tuple(f for n in order for f in filled if f.name == n)
    if not kept:
        empty = df.sparkSession.createDataFrame([], "feature string")
        return Analysis(problem, kept, chosen, *(Described(empty, empty, empty, {}) for _ in range(2)))
    described = []
    for name in ("train", "test"):
        with stage(f"describe {name}"):
            described.append(describe(cut_lineage(enrich(parts[name], kept, key, [key, target], tables, computers=computers)), key, target, kept, problem))
    return Analysis(problem, kept, chosen, *described)
