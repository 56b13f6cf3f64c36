"""Sources: files, tables, SQL, frames and functions as lazy DataFrames with a checked schema."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from io import StringIO
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftloom.functions.text import unique_names
from driftloom.session import placed, shared_folder
from driftloom.types import check_schema, restore_types, strip_time_zones

#: Rows of one batch where batches are asked for.
BATCH_ROWS = 10_000
#: Null in CSV of exact texts.
NULL_TEXT = "\x1fnull\x1f"


def checked(df: DataFrame) -> DataFrame:
    """``df`` with wall-clock times only; fails on repeated names and unsupported types. Only the schema is looked at."""
    df = strip_time_zones(df)
    check_schema(df.schema)
    return df


def from_csv(
    spark: SparkSession, path: str | list[str] | StringIO, schema: T.StructType | str | None = None, *, header: bool = True, sep: str = ",", quote: str = '"', escape: str = '"', null_value: str = "", date_format: str | None = None, timestamp_format: str | None = None,
    skip_bad: bool = False, multi_line: bool = False, exact: bool = False, columns: dict[str, str] | None = None, kinds: dict[str, str] | None = None, names: list[str] | None = None, null_values: list[str] | None = None, not_null: list[str] | None = None, all_text: bool = False, sample_share: float | None = None,
    encoding: str | None = None, comment: str | None = None, line_end: str | None = None, decimal: str | None = None, longest_value: int | None = None, plain_names: bool = False, file_name: str | None = None, rejects: str | None = None, partition_kinds: bool = True, **options: Any,
) -> DataFrame:
    """CSV of a path, several paths or a text in memory. Without a schema the types are inferred by one pass over the data.

    ``columns``: the schema as names and SQL types; ``kinds``: types of some columns after reading; ``names``: other column names;
    ``null_values``: more texts that mean null; ``not_null``: text columns where null is ''; ``all_text``: no inference;
    ``sample_share``: share of the rows inferred from; ``decimal``: the decimal mark; ``plain_names``: lower-case names of letters, digits and _;
    ``file_name``: a column with the file's path; ``rejects``: a column with the lines that don't fit (a schema is needed); ``partition_kinds``:
    types of partition folders are inferred. ``exact`` is for the files that ``into_csv`` writes with it.
    """
    if columns is not None:
        schema = ", ".join(f"`{c}` {k}" for c, k in columns.items())
    if isinstance(path, StringIO):
        lines = path.getvalue().splitlines()
        text = spark.createDataFrame([(x,) for x in lines], "value string")
        source: Any = text.rdd.map(lambda row: row[0]) if not multi_line else None
        if source is None:
            raise ValueError("a text in memory can't have values of several lines")
    else:
        source = path
    if exact:
        null_value, multi_line = NULL_TEXT, True
        options = {"emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxCharsPerColumn": -1} | options
    opts = {"header": header, "sep": sep, "quote": quote, "escape": escape, "nullValue": null_value, "mode": "DROPMALFORMED" if skip_bad else "PERMISSIVE", "multiLine": multi_line, "preferDate": "true", **options}
    opts |= {k: v for k, v in (("dateFormat", date_format), ("timestampFormat", timestamp_format), ("encoding", encoding), ("comment", comment), ("lineSep", line_end), ("samplingRatio", sample_share), ("maxCharsPerColumn", longest_value), ("columnNameOfCorruptRecord", rejects)) if v is not None}
    reader = spark.read.options(**opts)
    if schema is not None:
        parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        reader = reader.schema(T.StructType([*parsed.fields, T.StructField(rejects, T.StringType())]) if rejects else parsed)
    else:
        reader = reader.option("inferSchema", not all_text)
    kept = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", partition_kinds)
    try:
        df = reader.csv(source)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", kept)
    if file_name:
        df = df.withColumn(file_name, F.col("_metadata.file_path"))
    if names:
        df = df.toDF(*names, *df.columns[len(names) :])
    if plain_names:
        df = df.toDF(*unique_names([re.sub(r"\W+", "_", c).strip("_").lower() or "column" for c in df.columns]))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if null_values:
        df = df.withColumns({c: F.when(~F.col(f"`{c}`").isin(null_values), F.col(f"`{c}`")) for c in texts})
    if not_null:
        df = df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in not_null})
    if decimal:
        numbers = [c for c, k in (kinds or {}).items() if k in ("double", "float")]
        df = df.withColumns({c: F.translate(F.col(f"`{c}`").cast("string"), decimal, ".") for c in numbers})
    if kinds:
        df = df.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in kinds.items()})
    return checked(df)


def from_parquet(spark: SparkSession, path: str | list[str], *, merge_schema: bool = False, file_name: str | None = None) -> DataFrame:
    """Parquet with partition folders as columns; ``merge_schema`` unites columns by name, ``file_name`` adds the file's path."""
    paths = [path] if isinstance(path, str) else path
    df = spark.read.option("mergeSchema", merge_schema).parquet(*paths)
    return checked(df.withColumn(file_name, F.col("_metadata.file_path")) if file_name else df)


def from_ndjson(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *, skip_bad: bool = False) -> DataFrame:
    reader = spark.read.option("mode", "DROPMALFORMED" if skip_bad else "PERMISSIVE")
    return checked((reader.schema(schema) if schema is not None else reader).json(path))


def from_table(spark: SparkSession, name: str) -> DataFrame:
    return checked(spark.table(name))


def from_sql(spark: SparkSession, query: str | Callable[[SparkSession], DataFrame], args: dict | list | None = None) -> DataFrame:
    return checked(query(spark) if callable(query) else spark.sql(query, args=args) if args else spark.sql(query))


def from_frame(spark: SparkSession, frame: pd.DataFrame | pa.Table | DataFrame, schema: T.StructType | None = None) -> DataFrame:
    if isinstance(frame, DataFrame):
        return checked(frame)
    return checked(spark.createDataFrame(frame, schema) if schema is not None else spark.createDataFrame(frame))


def from_opener(spark: SparkSession, opener: Callable[[SparkSession], DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """Whatever a function opens. With a schema its columns are selected and cast to it; what doesn't fit fails."""
    df = opener(spark)
    return checked(df if schema is None else restore_types(df.select(*(f"`{n}`" for n in schema.names)), schema))


def from_batches(spark: SparkSession, batches: Iterable[pd.DataFrame] | Callable[[], Iterable[pd.DataFrame]], schema: T.StructType, rows_at_once: int = 500_000) -> DataFrame:
    """Batches made in the driver, one after another. They are put into the shared folder as they come, so neither the driver nor the plan
    grows with them.
    """
    place, waiting, rows = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex[:12]}", [], 0
    spark.createDataFrame([], schema).write.parquet(place)
    for pdf in itertools.chain(batches() if callable(batches) else batches, [None]):
        if pdf is not None:
            waiting.append(pdf)
            rows += len(pdf)
        if waiting and (pdf is None or rows >= rows_at_once):
            spark.createDataFrame(pd.concat(waiting, ignore_index=True), schema).write.mode("append").parquet(place)
            waiting, rows = [], 0
    return checked(spark.read.schema(schema).parquet(place))


def from_function(spark: SparkSession, make: Callable[[int], Iterable[pd.DataFrame]], parts: int, schema: T.StructType | str) -> DataFrame:
    """Rows that a function makes in the executors, part by part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pdf["id"]:
                yield from make(int(part))

    return checked(spark.range(0, parts, 1, parts).mapInPandas(run, schema))


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; the schemas must agree in names and types."""
    kinds = lambda d: {f.name: f.dataType for f in d.schema.fields}
    if kinds(a) != kinds(b):
        raise ValueError(f"schemas differ: {a.schema.simpleString()} and {b.schema.simpleString()}")
    return a.unionByName(b)


def map_batches(df: DataFrame, schema: T.StructType | str, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``fn`` on each Arrow batch, in the executors."""
    return df.mapInPandas(lambda it: (fn(pdf) for pdf in it), schema)


def batches(df: DataFrame, rows: int = BATCH_ROWS) -> Iterator[pa.Table]:
    """The rows in the driver, some at a time; no more than a partition is there at once."""
    kinds = to_arrow_schema(df.schema)
    left = df.toLocalIterator(prefetchPartitions=True)
    while chunk := list(itertools.islice(left, rows)):
        yield pa.Table.from_pylist([r.asDict(recursive=True) for r in chunk], schema=kinds)


def arrow_reader(df: DataFrame, rows: int = BATCH_ROWS) -> pa.RecordBatchReader:
    """A reader of Arrow batches, for libraries that take one."""
    return pa.RecordBatchReader.from_batches(to_arrow_schema(df.schema), (b for t in batches(df, rows) for b in t.to_batches()))


def load(df: DataFrame, most_rows: int = 10_000_000) -> pa.Table:
    """A bounded result as one Arrow table; more rows are an error."""
    got = df.limit(most_rows + 1).toArrow()
    if got.num_rows > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return got


def by_places(df: DataFrame, order: str, offset: int, length: int | None = None) -> DataFrame:
    """Rows at the places ``offset`` to ``offset + length`` (to the end without it) in the order of a unique column."""
    if offset < 0 or length is not None and length < 0:
        raise ValueError("places begin at 0")
    at = F.col("_at")
    return placed(df, [order], {"_at": None}).where((at >= offset) & (at < offset + length if length is not None else F.lit(True))).drop("_at")


def beside(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both for the same rows, by a unique key; repeated names are an error."""
    if clash := (set(a.columns) & set(b.columns)) - {key}:
        raise ValueError(f"repeated columns: {sorted(clash)}")
    return a.join(b, key)


def size(df: DataFrame) -> int:
    return df.count()


def cheap_size(df: DataFrame) -> int | None:
    """The number of rows where it costs next to nothing, as of plain files and local rows; else none."""
    plan = df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName()
    return df.count() if plan in ("LogicalRelation", "LocalRelation", "DataSourceV2ScanRelation", "Range") else None


def sample_text(df: DataFrame, n: int = 10) -> str:
    return df.limit(n).toPandas().to_string(index=False)
