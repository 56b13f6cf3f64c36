"""Sinks: tables with replace, append and fail; CSV, Parquet and NDJSON folders; functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from driftloom.sources.readers import NULL_TEXT

REPLACE, APPEND, FAIL = "replace", "append", "fail"


def _kinds(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def into_table(df: DataFrame, name: str, if_exists: str = FAIL, create: bool = True, bucket_by: tuple[int, str] | None = None) -> None:
    """Writes a table. Append needs the same schema; without ``create`` the table must be there.

    A table that is replaced stays until the new one is written whole, so a failed write changes nothing.
    ``bucket_by`` (buckets, column) lays it out so that joins on the column need no shuffle.
    """
    spark = df.sparkSession
    there = spark.catalog.tableExists(name)
    if not there and not create:
        raise ValueError(f"no table {name}")
    if there and if_exists == FAIL:
        raise ValueError(f"table {name} exists")
    if there and if_exists == APPEND:
        if _kinds(spark.table(name)) != _kinds(df):
            raise ValueError(f"the schema of {name} is another")
        df.write.mode("append").format("parquet").saveAsTable(name)
        return
    with transaction(spark) as t:
        t.write(df, name, bucket_by)


class Transaction:
    """Tables written aside, to take their places together."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tag, self.written = spark, uuid.uuid4().hex[:8], list[tuple[str, str]]()

    def write(self, df: DataFrame, name: str, bucket_by: tuple[int, str] | None = None) -> None:
        aside = f"{name}__{self.tag}_{len(self.written)}"
        writer = df.write.mode("error").format("parquet")
        self.written.append((name, aside))
        (writer.bucketBy(*bucket_by) if bucket_by else writer).saveAsTable(aside)

    def commit(self) -> None:
        moved = []
        try:
            for name, _ in self.written:
                if self.spark.catalog.tableExists(name):
                    self.spark.sql(f"ALTER TABLE {name} RENAME TO {name}__{self.tag}_old")
                    moved.append(name)
            for name, aside in self.written:
                self.spark.sql(f"ALTER TABLE {aside} RENAME TO {name}")
        except Exception:
            for name in moved:
                if not self.spark.catalog.tableExists(name):
                    self.spark.sql(f"ALTER TABLE {name}__{self.tag}_old RENAME TO {name}")
            raise
        for name in moved:
            self.spark.sql(f"DROP TABLE {name}__{self.tag}_old")

    def drop(self) -> None:
        for _, aside in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {aside}")


@contextmanager
def transaction(spark: SparkSession) -> Iterator[Transaction]:
    """All tables written inside appear at its end, or none of them."""
    t = Transaction(spark)
    try:
        yield t
        t.commit()
    finally:
        t.drop()


def layout(spark: SparkSession, name: str) -> tuple[int, list[str]] | None:
    """(buckets, columns) by which a table is laid out, none if it isn't."""
    facts = {r["col_name"].strip(): r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    n = facts.get("Num Buckets")
    return (int(n), [c.strip().strip("`") for c in facts["Bucket Columns"].strip("[]").split(",")]) if n and int(n) > 0 else None


def into_csv(df: DataFrame, path: str, *, header: bool = True, sep: str = ",", partition_by: tuple[str, ...] = (), compression: str = "none", mode: str = "overwrite", exact: bool = False) -> None:
    """A folder of CSV. Space at the ends of texts is dropped and '' can't be told from null, unless the texts are to be ``exact``;
    such files are read by ``from_csv`` with ``exact`` too, and only a text that is ``NULL_TEXT`` itself becomes null.
    """
    kept = {"quoteAll": True, "nullValue": NULL_TEXT, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} if exact else {}
    df.write.mode(mode).options(header=header, sep=sep, compression=compression, escape='"', **kept).partitionBy(*partition_by).csv(path)


def into_parquet(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = (), compression: str = "zstd", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", compression).partitionBy(*partition_by).parquet(path)


def into_ndjson(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def into_function(df: DataFrame, write: Callable[[DataFrame], None]) -> None:
    write(df)


def copy(df: DataFrame, sink: Callable[[DataFrame], None]) -> DataFrame:
    sink(df)
    return df
