"""Features: named functions of a row, as column expressions, Python, SQL over the table and secondary tables, or a text oracle.

Each kind has a computer. Expression features are one ``select``; Python features are Arrow UDFs of that same ``select``, which Spark
runs in one pass; a SQL feature keeps the row's key in its result and is joined back by it, so no order is relied upon.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from driftloom.functions.text import FALSE_WORDS, TRUE_WORDS, as_number, unique_names
from driftloom.operators.cache import Memory, cache_key
from driftloom.session import cut_lineage
from driftloom.sources.catalog import time_limit

OTHER = "_other_"
INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1
#: Features of one table where many are written (``enrich_tables``).
FEATURES_AT_ONCE = 1000
SQL_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "category": "string"}


class FeatureError(ValueError):
    """A feature that can't be built; ``code`` says why (illegal, width, dtype, height, timeout, shadowing)."""

    def __init__(self, code: str, text: str) -> None:
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass(frozen=True)
class Feature:
    """``kind``: int, float, bool or category. One of these defines it: ``expression`` (SQL of the row), ``query`` (SELECT of one
    column over the view ``primary_table``, which has the column ``_row_key``, and the named secondary tables), ``row`` (Python function of
    the values of ``params`` in one row), ``batch`` (function of a pandas frame of them that gives a series) and ``question`` (put to a text
    oracle about the text in the column ``params[0]``; what it answers must fit the kind).
    """

    name: str
    kind: str
    expression: str | None = None
    query: str | None = None
    categories: tuple[str, ...] = ()
    default_missing: Any = None
    default_nan: float | None = None
    default_inf: float | None = None
    default_neg_inf: float | None = None
    description: str = ""
    tables: tuple[str, ...] = ()
    params: tuple[str, ...] = ()
    #: Access paths to secondary tables it uses, as table.name.
    strategies: tuple[str, ...] = ()
    row: Callable | None = None
    batch: Callable[[pd.DataFrame], pd.Series] | None = None
    question: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in SQL_TYPES:
            raise FeatureError("dtype", f"unknown kind {self.kind}")
        if self.kind == "category" and (not self.categories or "" in self.categories or len(set(self.categories)) < len(self.categories)):
            raise FeatureError("illegal", f"categories of {self.name} must be non-empty, distinct and not ''")
        if sum(x is not None for x in (self.expression, self.query, self.row, self.batch, self.question)) != 1:
            raise FeatureError("illegal", f"{self.name} needs one of expression, query, row, batch and question")
        if (self.row or self.batch or self.question) and not self.params:
            raise FeatureError("illegal", f"{self.name} needs the names of its params")

    def typed(self, raw: Column) -> Column:
        """A raw value as this feature's type: integers are clipped to 64 bits, categories beyond the list become ``_other_``."""
        if self.kind == "int":
            return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(INT64_MIN)), F.lit(INT64_MAX)).cast("bigint"))
        if self.kind == "category":
            return F.when(raw == "", F.lit(None)).when(~raw.isin(list(self.categories)), F.lit(OTHER)).otherwise(raw)
        return raw.cast(SQL_TYPES[self.kind])

    def safe(self, raw: Column) -> Column:
        """As ``typed``, but values that don't fit become null."""
        return self.typed(raw if self.kind == "category" else raw.try_cast(SQL_TYPES[self.kind]))

    def with_defaults(self, c: Column) -> Column:
        """Defaults for null and, of floats, NaN and the infinities; kinds without a default stay."""
        if self.kind == "float":
            for bad, d in ((F.isnan(c), self.default_nan), (c == float("inf"), self.default_inf), (c == float("-inf"), self.default_neg_inf)):
                c = c if d is None else F.when(bad, F.lit(float(d))).otherwise(c)
        return c if self.default_missing is None else F.coalesce(c, F.lit(self.default_missing))

    def to_dict(self) -> dict:
        if self.row or self.batch:
            raise FeatureError("illegal", f"{self.name} is Python code and can't be written as JSON")
        return {"type": "feature", **{k: v for k, v in asdict(self).items() if k not in ("row", "batch")}}

    @staticmethod
    def from_dict(d: dict) -> "Feature":
        d = {k: v for k, v in d.items() if k != "type"}
        return Feature(**d | {k: tuple(d.get(k, ())) for k in ("categories", "tables", "params", "strategies")})


def sql_feature(df: DataFrame, name: str, query: str, key: str, tables: dict[str, DataFrame] | None = None, categories: Sequence[str] = ()) -> Feature:
    """A SQL feature with its kind told from the query's schema; analysed only, no job runs."""
    schema = _run_query(df.limit(0), query, key, tables or {}).schema
    values = [f for f in schema.fields if f.name != "_row_key"]
    if len(values) != 1:
        raise FeatureError("width", f"one value column beside _row_key expected, found {[f.name for f in values]}")
    dtype = values[0].dataType
    if isinstance(dtype, T.BooleanType):
        kind = "bool"
    elif isinstance(dtype, T.IntegralType):
        kind = "int"
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        kind = "float"
    elif isinstance(dtype, T.StringType) and categories:
        kind = "category"
    else:
        raise FeatureError("dtype", f"{dtype.simpleString()} can't be a feature")
    return Feature(name, kind, query=query, categories=tuple(categories), tables=tuple(tables or {}))


def _run_query(df: DataFrame, query: str, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The query over temporary views that only it sees: names are made unique and are dropped at once."""
    spark, tag = df.sparkSession, uuid.uuid4().hex[:12]
    if "primary_table" in tables:
        raise FeatureError("shadowing", "a secondary table is called primary_table")
    views = {"primary_table": df.withColumn("_row_key", F.col(key)), **tables}
    try:
        return _with_views(spark, query, views, tag)
    except AnalysisException as e:
        raise FeatureError("illegal", str(e).splitlines()[0]) from e


def _with_views(spark, query: str, views: dict[str, DataFrame], tag: str) -> DataFrame:
    # a CTE per table hides any view of the same name in the session
    for n, v in views.items():
        v.createOrReplaceTempView(f"_{tag}_{n}")
    try:
        heads = ", ".join(f"`{n}` AS (SELECT * FROM _{tag}_{n})" for n in views)
        return spark.sql(f"WITH {heads} SELECT * FROM ({query})")
    finally:
        for n in views:
            spark.catalog.dropTempView(f"_{tag}_{n}")


def _python_column(feature: Feature, safe: bool) -> Column:
    """The raw values of a Python feature. Errors: null in that row (``row``) or batch (``batch``) if ``safe``, else the job fails."""
    one, many, kind = feature.row, feature.batch, feature.kind

    def fit(v: Any) -> Any:
        if v is None or v is pd.NA:
            return None
        return {"int": lambda x: max(min(int(x), INT64_MAX), INT64_MIN), "float": float, "bool": bool, "category": str}[kind](v)

    def by_row(*values: Any) -> Any:
        try:
            return fit(one(*values))
        except Exception:
            if safe:
                return None
            raise

    def run(frame: pd.DataFrame) -> pd.Series:
        frame = frame.astype(object).where(frame.notna(), None)
        if one is not None:
            found = [by_row(*values) for values in frame.itertuples(index=False, name=None)]
        else:
            try:
                made = many(frame)
                if len(made) != len(frame):
                    raise FeatureError("height", f"{feature.name} gave {len(made)} values for {len(frame)} rows")
                found = [fit(v) for v in pd.Series(made).astype(object).where(pd.Series(made).notna(), None)]
            except Exception:
                if not safe:
                    raise
                found = [None] * len(frame)
        return pd.Series(found, dtype={"int": "Int64", "float": "Float64", "bool": "boolean", "category": object}[kind])

    def udf(frame: pd.DataFrame) -> pd.Series:
        return run(frame)

    udf.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(udf, SQL_TYPES[kind])(F.struct(*(F.col(f"`{p}`") for p in feature.params)))


class ExpressionComputer:
    """SQL expressions of the row and Python functions: columns of one select."""

    def supports(self, feature: Feature) -> bool:
        return feature.query is None and feature.question is None

    def compute(self, df: DataFrame, features: list[tuple[Feature, str]], carry: list[str], key: str | None, tables: dict[str, DataFrame], safe: bool) -> DataFrame:
        values = []
        for f, n in features:
            raw = F.expr(f.expression) if f.expression is not None else _python_column(f, safe)
            values.append((f.safe if safe else f.typed)(raw).alias(n))
        return df.select(*(F.col(f"`{c}`") for c in carry), *values)


class SqlComputer:
    """Queries over the table: each result is joined back by the row's key."""

    def supports(self, feature: Feature) -> bool:
        return feature.query is not None

    def compute(self, df: DataFrame, features: list[tuple[Feature, str]], carry: list[str], key: str | None, tables: dict[str, DataFrame], safe: bool) -> DataFrame:
        out = df.select(*(F.col(f"`{c}`") for c in carry))
        for f, n in features:
            result = _run_query(df, f.query, key, tables)
            value = next(c for c in result.columns if c != "_row_key")
            side = result.select(F.col("_row_key").alias("_k"), (f.safe if safe else f.typed)(F.col(f"`{value}`")).alias(n))
            out = out.join(side, F.col(f"`{key}`") == F.col("_k"), "left").drop("_k")
        return out


#: Computers in the order they are asked.
COMPUTERS = (ExpressionComputer(), SqlComputer())


def enrich(df: DataFrame, features: Sequence[Feature], key: str | None = None, keep: Sequence[str] = (), tables: dict[str, DataFrame] | None = None, defaults: bool = False, safe: bool = False, check_seconds: float | None = None, computers: Sequence = COMPUTERS) -> DataFrame:
    """``keep`` and all features, in order; names are kept apart with ``_``. SQL features need ``key``, a unique column.

    Each feature is computed by the first computer that supports it, in one go with the others of that computer. With ``check_seconds``
    every SQL feature is tried first: it must give one row per row within so many seconds.
    """
    names = unique_names([f.name for f in features], set(keep))
    groups: list[tuple[Any, list[tuple[Feature, str]]]] = [(c, []) for c in computers]
    for f, n in zip(features, names):
        own = next((g for c, g in groups if c.supports(f)), None)
        if own is None:
            raise FeatureError("illegal", f"no computer for {f.name}")
        own.append((f, f"_f_{n}"))
    queries = [f for f in features if f.query is not None]
    if (queries or sum(bool(g) for _, g in groups) > 1) and key is None:
        raise FeatureError("illegal", "SQL features, and features of several kinds, need a key")
    if check_seconds is not None:
        for f in queries:
            check_height(df, f, key, tables, check_seconds)
    out, used = None, [(c, g) for c, g in groups if g]
    carry = list(dict.fromkeys([*keep, *([key] if key is not None and (queries or len(used) > 1) else [])]))
    for computer, group in used:
        part = computer.compute(df, group, carry if out is None else [key], key, tables or {}, safe)
        out = part if out is None else out.join(part.withColumnRenamed(key, "_k"), F.col(f"`{key}`") == F.col("_k"), "left").drop("_k")
    out = df.select(*(F.col(f"`{c}`") for c in carry)) if out is None else out
    value = lambda f, n: f.with_defaults(F.col(f"`_f_{n}`")) if defaults else F.col(f"`_f_{n}`")
    return out.select(*(F.col(f"`{c}`") for c in keep), *(value(f, n).alias(n) for f, n in zip(features, names)))


def enrich_tables(df: DataFrame, features: Sequence[Feature], key: str, write: Callable[[int, DataFrame], DataFrame], tables: dict[str, DataFrame] | None = None, at_once: int = FEATURES_AT_ONCE, **options: Any) -> DataFrame:
    """All features of a very wide set: computed and written ``at_once`` a table, each with the key, and joined by it again.

    ``write`` stores a table under its number and gives it back; stored bucketed by the key, the tables join without a shuffle.
    """
    names = unique_names([f.name for f in features], {key})
    named = [replace(f, name=n) for f, n in zip(features, names)]
    parts = [write(i // at_once, enrich(df, named[i : i + at_once], key, [key], tables, **options)) for i in range(0, len(named), at_once)]
    return join_by_key(parts, key) if parts else df.select(key)


def join_by_key(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Tables of the same rows side by side."""
    out = parts[0]
    for p in parts[1:]:
        if clash := (set(out.columns) & set(p.columns)) - {key}:
            raise ValueError(f"repeated columns: {sorted(clash)}")
        out = out.join(p, key)
    return out


def check_height(df: DataFrame, feature: Feature, key: str, tables: dict[str, DataFrame] | None = None, seconds: float | None = None) -> None:
    """Fails unless a SQL feature gives one row per row of the table, by its keys, within so many seconds."""
    result = _run_query(df, feature.query, key, tables or {}).groupBy(F.col("_row_key").alias("k")).agg(F.count("*").alias("n"))
    both = df.select(F.col(f"`{key}`").alias("_k"), F.lit(1).alias("_own")).join(result, F.col("_k") == F.col("k"), "full_outer")
    began = time.monotonic()
    try:
        with time_limit(df.sparkSession, seconds) if seconds is not None else nullcontext():
            bad = both.where("_own IS NULL OR n IS NULL OR n > 1").limit(1).count()
    except Exception as e:
        if seconds is not None and time.monotonic() - began >= seconds:
            raise FeatureError("timeout", f"{feature.name} took more than {seconds} s") from e
        raise
    if bad:
        raise FeatureError("height", f"{feature.name} doesn't give one row per row")


@dataclass(frozen=True)
class TextOracle:
    """A language model, or what stands in for it: answers a question about a text. ``answer`` takes (question, text).

    ``most_at_once`` bounds the calls of one Python worker that run side by side; ``remembered`` is how many answers a worker keeps.
    """

    answer: Callable[[str, str], str | None]
    name: str = "oracle"
    most_at_once: int = 1
    remembered: int = 10_000

    def column(self, df: DataFrame, text: str, question: str, out: str, cache: DataFrame | None = None) -> DataFrame:
        """``df`` with the answers. Equal texts are asked once; a failed answer is null and fails no other.

        ``cache``: answers of earlier runs (``answers``), which aren't asked again.
        """
        keyed = df.withColumn("_key", cache_key(F.lit(self.name), F.lit(question), F.col(text)))
        answers = self.answers(df, text, question, cache).select(F.col("key").alias("_k"), F.col("answer").alias(out))
        # joined by hash: texts may be long, and a hot one is a hot key, which AQE splits on the side of the rows
        return keyed.join(answers, F.col("_key") == F.col("_k"), "left").select(*df.columns, out)

    def answers(self, df: DataFrame, text: str, question: str, cache: DataFrame | None = None) -> DataFrame:
        """(key, answer) of every distinct text: what the cache knows, and the rest asked."""
        answer, at_once, kept = self.answer, self.most_at_once, self.remembered

        def ask(batches):
            memory = Memory(kept)

            def one(t: str) -> str | None:
                try:
                    return memory.get(t, lambda: answer(question, t))
                except Exception:  # noqa: BLE001
                    return None

            with ThreadPoolExecutor(at_once) as pool:
                for pdf in batches:
                    yield pd.DataFrame({"key": pdf["key"].astype(object), "answer": pd.Series(list(pool.map(one, pdf["text"])), dtype=object, index=pdf.index)})

        texts = df.where(F.col(text).isNotNull()).select(cache_key(F.lit(self.name), F.lit(question), F.col(text)).alias("key"), F.col(text).alias("text"))
        distinct = texts.groupBy("key").agg(F.first("text").alias("text"))
        if cache is None:
            return distinct.mapInPandas(ask, "key string, answer string")
        known = distinct.select("key").join(cache.select("key", "answer"), "key")
        return known.unionByName(distinct.join(cache.select("key"), "key", "left_anti").mapInPandas(ask, "key string, answer string"))


def answer_typed(answer: Column, kind: str, categories: Sequence[str] = ()) -> Column:
    """A text answer as a kind; what doesn't fit is null, a category beyond the list ``_other_``; kind ``str`` stays text."""
    if kind == "bool":
        return F.when(F.lower(answer).isin(*TRUE_WORDS), True).when(F.lower(answer).isin(*FALSE_WORDS), False)
    if kind in ("int", "float"):
        return as_number(answer, SQL_TYPES[kind])
    if kind == "category":
        return F.when(answer == "", F.lit(None)).when(~answer.isin(list(categories)), F.lit(OTHER)).otherwise(answer)
    return answer


class OracleComputer:
    """Questions about a text column, by a text oracle; given to ``enrich`` beside ``COMPUTERS``.

    The first question of a text is answered and kept before the others are asked, so a model's cache of the text serves those. An answer
    that fails is null in its own column only.
    """

    def __init__(self, oracle: TextOracle, cache: DataFrame | None = None) -> None:
        self.oracle, self.cache = oracle, cache

    def supports(self, feature: Feature) -> bool:
        return feature.question is not None

    def compute(self, df: DataFrame, features: list[tuple[Feature, str]], carry: list[str], key: str | None, tables: dict[str, DataFrame], safe: bool) -> DataFrame:
        texts = list(dict.fromkeys(f.params[0] for f, _ in features))
        out = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*carry, *texts])))
        for i, (f, n) in enumerate(features):
            out = self.oracle.column(out, f.params[0], f.question, n, self.cache)
            out = out.withColumn(n, answer_typed(F.col(f"`{n}`"), f.kind, f.categories))
            if i == 0 and len(features) > 1:
                out = cut_lineage(out)
        return out.select(*(F.col(f"`{c}`") for c in carry), *(F.col(f"`{n}`") for _, n in features))


def keyword_oracle() -> TextOracle:
    """A deterministic stand-in for a model: a question ending in ``: a, b, c`` is answered with the first option the text
    names, else ``none``; any other with the number of words.
    """

    def answer(question: str, text: str) -> str:
        if ": " in question:
            options = [o.strip() for o in question.rsplit(": ", 1)[1].split(",")]
            return next((o for o in options if o.lower() in text.lower()), "none")
        return str(len(text.split()))

    return TextOracle(answer, "keyword")


def evolve(feature: Feature, **changes: Any) -> Feature:
    return replace(feature, **changes)
