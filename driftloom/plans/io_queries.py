"""Round trips through sinks and sources, and streams. Files go to the shared folder of the session."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators.features import Feature
from driftloom.plans.registry import query
from driftloom.session import shared_folder, table
from driftloom.sources import catalog, readers, sinks
from driftloom.streaming import enrich as streams

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query(_ORDERS)
def parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, df = _place(spark, "parquet"), _orders(spark, d)
    sinks.into_parquet(df, path, partition_by=("o_orderstatus",))
    return readers.from_parquet(spark, path).select(*df.columns)


@query(_ORDERS)
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, df = _place(spark, "csv"), _orders(spark, d)
    sinks.into_csv(df, path)
    return readers.from_csv(spark, path, df.schema)


@query("SELECT pair_id, prompt, response FROM responses WHERE response IS NOT NULL AND response <> ''")
def csv_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _csv_texts(spark, d).where("response IS NOT NULL AND response <> ''")


@query("SELECT pair_id, prompt, response FROM responses")
def csv_all_texts_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _csv_texts(spark, d)


def _csv_texts(spark: SparkSession, d: str) -> DataFrame:
    path, df = _place(spark, "csv"), table(spark, d, "responses").select("pair_id", "prompt", "response")
    sinks.into_csv(df, path, exact=True)
    return readers.from_csv(spark, path, df.schema, exact=True)


@query(_ORDERS)
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, df = _place(spark, "json"), _orders(spark, d)
    sinks.into_ndjson(df, path)
    return readers.from_ndjson(spark, path, df.schema).select(*df.columns)


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "csv")
    sinks.into_csv(table(spark, d, "nation"), path)
    return readers.from_csv(spark, path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_sink(spark: SparkSession, d: str) -> DataFrame:
    with catalog.scratch_database(spark) as db:
        nation, name = table(spark, d, "nation"), f"{db}.nation"
        sinks.into_table(nation, name)
        sinks.into_table(nation, name, sinks.APPEND)
        kept = readers.from_table(spark, name)
        rows = kept.collect()  # 50 rows; the scratch table is dropped here
    return spark.createDataFrame(rows, kept.schema)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def sql_source(spark: SparkSession, d: str) -> DataFrame:
    view = catalog.scratch_view(table(spark, d, "orders"))
    return readers.from_sql(spark, f"SELECT o_orderstatus, count(*) AS n FROM {view} WHERE o_totalprice > :least GROUP BY 1", {"least": 100_000})


@query("SELECT 'nation.parquet' AS file, count(*) AS n FROM nation")
def parquet_file_name(spark: SparkSession, d: str) -> DataFrame:
    df = readers.from_parquet(spark, os.path.join(d, "nation.parquet"), file_name="file")
    return df.select(F.regexp_extract("file", r"([^/]*nation\.parquet)", 1).alias("file")).groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def map_batches(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    parts = readers.map_batches(own, "l_returnflag string, n long, quantity double", lambda p: p.groupby("l_returnflag", as_index=False).agg(n=("l_quantity", "size"), quantity=("l_quantity", "sum")).astype({"l_returnflag": object}))
    return parts.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


_STREAMED = [Feature("big", "bool", "value > 50", default_missing=False), Feature("kind", "category", "event_type", categories=("click", "view"), default_missing="_other_")]


@query("SELECT event_id, coalesce(value > 50, false) AS big, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '_other_' END AS kind FROM events")
def stream_enrich(spark: SparkSession, d: str) -> DataFrame:
    stream = streams.read_files(spark, d, table(spark, d, "events").schema, pattern="events.parquet")
    out = _place(spark, "stream")
    streams.write_all(streams.enrich_stream(stream, _STREAMED, ["event_id"], defaults=True), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    stream = streams.read_files(spark, d, table(spark, d, "events").schema, pattern="events.parquet")
    out = _place(spark, "windows")
    counted = streams.windowed_counts(stream.where("ts IS NOT NULL"), "ts", "event_type", "1 day").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    streams.write_latest(counted, f"{out}/rows", f"{out}/state")
    return spark.read.schema("start timestamp_ntz, event_type string, n long").parquet(f"{out}/rows")


@query("SELECT event_id, coalesce(value > 50, false) AS big, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '_other_' END AS kind FROM events")
def stream_in_steps(spark: SparkSession, d: str) -> DataFrame:
    """A bounded number of files at a time: several micro-batches give what one gives."""
    place, events = _place(spark, "steps"), table(spark, d, "events")
    events.repartition(4, "event_id").write.parquet(f"{place}/in")
    stream = streams.read_files(spark, f"{place}/in", events.schema, files_at_once=1)
    done = streams.write_all(streams.enrich_stream(stream, _STREAMED, ["event_id"], defaults=True), f"{place}/rows", f"{place}/state")
    if len(done.recentProgress) < 4:
        raise AssertionError("the files weren't read one at a time")
    return spark.read.parquet(f"{place}/rows")
