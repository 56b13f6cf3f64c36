"""One object for a session: sources, sinks, splits, features, analysis."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from driftloom.operators import analyze, features, generate, split
from driftloom.operators.features import Feature, TextOracle, keyword_oracle
from driftloom.operators.models import Models, ModelSpec, default_models
from driftloom.operators.joins import Conversations, Lookup, TimeSeries
from driftloom.sources import catalog, readers, sinks


@dataclass(frozen=True)
class Defaults:
    train_fraction: float = 0.8
    search_rows: int = 10_000
    eval_rows: int = 100_000
    max_classes: int = 20
    least_defined: int = 30
    most_features: int = 10


@dataclass(frozen=True)
class Settings:
    """Settings of a session of its own; those left out are Spark's defaults. Named ones go before equal keys of ``more``, the engine's own before all."""

    memory: str | None = None
    folder: str | None = None
    threads: int | None = None
    checkpoints: str | None = None
    more: dict[str, str] = field(default_factory=dict)

    def to_conf(self) -> dict[str, str]:
        named = {"spark.driver.memory": self.memory, "spark.local.dir": self.folder, "spark.master": None if self.threads is None else f"local[{self.threads}]", "spark.checkpoint.dir": self.checkpoints}
        own = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true", "spark.sql.adaptive.enabled": "true"}
        return {**self.more, **{k: v for k, v in named.items() if v is not None}, **own}

    def session(self) -> SparkSession:
        return SparkSession.builder.config(map=self.to_conf()).getOrCreate()


@dataclass
class Engine:
    spark: SparkSession
    defaults: Defaults = field(default_factory=Defaults)
    oracle: TextOracle = field(default_factory=keyword_oracle)
    models: Models = field(default_factory=default_models)

    @staticmethod
    def create(spark: SparkSession | None = None, **defaults: Any) -> "Engine":
        return Engine(spark or SparkSession.builder.getOrCreate(), Defaults(**defaults))

    def isolated(self, database: str | None = None) -> "Engine":
        """An engine whose views and settings are its own, over the same tables."""
        session = self.spark.newSession()
        if database is not None:
            session.catalog.setCurrentDatabase(database)
        return Engine(session, self.defaults, self.oracle, self.models)

    def csv(self, path: Any, **options: Any) -> DataFrame:
        return readers.from_csv(self.spark, path, **options)

    def parquet(self, path: Any, **options: Any) -> DataFrame:
        return readers.from_parquet(self.spark, path, **options)

    def ndjson(self, path: str, **options: Any) -> DataFrame:
        return readers.from_ndjson(self.spark, path, **options)

    def table(self, name: str) -> DataFrame:
        return readers.from_table(self.spark, name)

    def sql(self, query: Any, args: Any = None) -> DataFrame:
        return readers.from_sql(self.spark, query, args)

    def frame(self, frame: Any) -> DataFrame:
        return readers.from_frame(self.spark, frame)

    def save(self, df: DataFrame, name: str, if_exists: str = sinks.FAIL) -> DataFrame:
        sinks.into_table(df, name, if_exists)
        return self.table(name)

    def split(self, df: DataFrame, key: str) -> DataFrame:
        d = self.defaults
        return split.split(df, key, d.train_fraction, d.search_rows, d.eval_rows)

    def lookup(self, name: str, table: DataFrame, key: str, *columns: str) -> Lookup:
        return Lookup(name, table, key, columns)

    def time_series(self, name: str, table: DataFrame, key: str, at: str, *columns: str) -> TimeSeries:
        return TimeSeries(name, table, key, at, columns)

    def conversations(self, name: str, table: DataFrame, id: str, at: str, role: str, content: str, tie: str) -> Conversations:
        return Conversations(name, table, id, at, role, content, tie)

    def generate(self, df: DataFrame, target: str) -> list[Feature]:
        return generate.original_columns(df, target)

    def enrich(self, df: DataFrame, chosen: Sequence[Feature], **options: Any) -> DataFrame:
        return features.enrich(df, chosen, **options)

    def analyze(self, df: DataFrame, key: str, target: str, **options: Any) -> analyze.Analysis:
        d = self.defaults
        return analyze.analyze(df, key, target, **{"most": d.most_features, "least_defined": d.least_defined, "train_fraction": d.train_fraction, "search_rows": d.search_rows, "eval_rows": d.eval_rows} | options)

    def model(self, spec: ModelSpec) -> TextOracle:
        return self.models.get(spec)

    def forget_models(self) -> None:
        self.models.clear()

    def time_limit(self, seconds: float):
        return catalog.time_limit(self.spark, seconds)


def to_json(things: Sequence[Any]) -> str:
    return json.dumps([t.to_dict() for t in things], sort_keys=True)


#: What JSON can hold, by its type tag.
_READ = {"feature": Feature.from_dict, "problem": analyze.Problem.from_dict, "model": ModelSpec.from_dict}


def from_json(text: str) -> list[Any]:
    """Features, problems and models that ``to_json`` wrote; an unknown type is an error."""
    return [_READ[d["type"]](d) for d in json.loads(text)]


def features_from_json(text: str) -> list[Feature]:
    return [x for x in from_json(text) if isinstance(x, Feature)]
