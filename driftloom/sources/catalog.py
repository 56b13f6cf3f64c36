"""Databases, tables and scratch names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(*parts: str) -> str:
    """A name in back ticks, safe in SQL."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}")


def drop_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {quoted(name)} CASCADE")


def databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def create_table(spark: SparkSession, name: str, schema: T.StructType, if_exists: str = "fail") -> None:
    head = {"fail": "CREATE TABLE", "ignore": "CREATE TABLE IF NOT EXISTS", "replace": "CREATE TABLE"}[if_exists]
    if if_exists == "replace":
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"{head} {name} ({schema.toDDL()}) USING parquet")


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def alter_types(df: DataFrame, kinds: dict[str, str], invalid_to_null: bool = False) -> DataFrame:
    """Columns with other types; what doesn't fit fails, or becomes null."""
    return df.withColumns({c: F.col(quoted(c)).try_cast(k) if invalid_to_null else F.col(quoted(c)).cast(k) for c, k in kinds.items()})


@contextmanager
def scratch_database(spark: SparkSession) -> Iterator[str]:
    """A database of a random name that is gone afterwards."""
    name = f"scratch_{uuid.uuid4().hex[:12]}"
    create_database(spark, name)
    try:
        yield name
    finally:
        drop_database(spark, name)


def sweep_scratch(spark: SparkSession) -> list[str]:
    """Drops scratch databases that earlier sessions left behind; for the start of a session that is alone with its catalog."""
    left = [d for d in databases(spark) if re.fullmatch(r"scratch_[0-9a-f]{12}", d)]
    for d in left:
        drop_database(spark, d)
    return left


def attach(spark: SparkSession, name: str, folder: str) -> list[str]:
    """A database over the Parquet files and folders of a folder, a table each; the files stay where they are."""
    create_database(spark, name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    tables = []
    for f in files:
        at = f.getPath()
        if at.getName().endswith(".parquet") or f.isDirectory() and not at.getName().startswith((".", "_")):
            tables.append(at.getName().removesuffix(".parquet"))
            kinds = spark.read.parquet(str(at.toString())).schema.toDDL()
            spark.sql(f"CREATE TABLE {quoted(name, tables[-1])} ({kinds}) USING parquet LOCATION '{at.toString()}'")
    return sorted(tables)


def detach(spark: SparkSession, name: str) -> None:
    """The database is gone from the catalog; attached files stay."""
    drop_database(spark, name)


def scratch_view(df: DataFrame) -> str:
    name = f"view_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(name)
    return name


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Jobs started inside are cancelled after so many seconds."""
    import threading

    tag = f"limit-{uuid.uuid4().hex}"
    spark.addTag(tag)
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        spark.removeTag(tag)
