"""Sources, sinks, catalog, sessions and frames beyond the file round trips."""

from __future__ import annotations

import uuid
from io import StringIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom import types
from driftloom.engine import Engine
from driftloom.functions.text import markdown_schema
from driftloom.operators import joins, sampling, split
from driftloom.plans.common import hash_sql
from driftloom.plans.registry import query
from driftloom.session import cut_lineage, shared_folder, table
from driftloom.sources import catalog, readers, sinks

_SUPPLIERS = "SELECT s_suppkey, s_name FROM supplier"
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_name")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("SELECT CAST(s_suppkey AS INT) AS s_suppkey, s_name FROM supplier")
def opener_source(spark: SparkSession, d: str) -> DataFrame:
    return readers.from_opener(spark, lambda s: table(s, d, "supplier"), T.StructType([T.StructField("s_suppkey", T.IntegerType()), T.StructField("s_name", T.StringType())]))


@query(_SUPPLIERS)
def frame_source(spark: SparkSession, d: str) -> DataFrame:
    return readers.from_frame(spark, readers.load(_suppliers(spark, d)))


@query(_SUPPLIERS)
def batch_source(spark: SparkSession, d: str) -> DataFrame:
    own = _suppliers(spark, d)
    return readers.from_batches(spark, lambda: (t.to_pandas() for t in readers.batches(own, 30)), own.schema, rows_at_once=70)


@query("SELECT range AS n, range % 7 AS rest FROM range(80)")
def function_source(spark: SparkSession, d: str) -> DataFrame:
    return readers.from_function(spark, lambda part: [pd.DataFrame({"n": range(10 * part, 10 * part + 10)}).assign(rest=lambda p: p["n"] % 7)], 8, "n long, rest long")


@query("SELECT event_id, ts FROM events")
def wall_clock_times(spark: SparkSession, d: str) -> DataFrame:
    return readers.checked(table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")))


@query("SELECT count(*) AS cheap, count(*) AS whole FROM orders")
def sizes(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    if readers.cheap_size(orders.where("o_custkey > 5")) is not None:
        raise AssertionError("a filtered table has no cheap size")
    return spark.createDataFrame([(readers.cheap_size(orders), readers.size(orders))], "cheap long, whole long")


@query("SELECT range AS batch, least(10000, (SELECT count(*) FROM orders) - range * 10000) AS n FROM range((SELECT CAST(ceil(count(*) / 10000) AS BIGINT) FROM orders))")
def batched_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, t.num_rows) for i, t in enumerate(readers.batches(table(spark, d, "orders").select("o_orderkey")))], "batch long, n long")


@query("SELECT count(*) AS n, sum(o_custkey) AS total FROM orders")
def arrow_reader(spark: SparkSession, d: str) -> DataFrame:
    n = total = 0
    for batch in readers.arrow_reader(table(spark, d, "orders").select("o_custkey")):
        n, total = n + batch.num_rows, total + sum(batch.column(0).to_pylist())
    return spark.createDataFrame([(n, total)], "n long, total long")


@query("SELECT least(count(*), 10) + 1 AS lines FROM orders")
def sample_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(len(readers.sample_text(_orders(spark, d)).splitlines()),)], "lines long")


@query("SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderstatus NOT IN ('P', 'O') THEN o_orderstatus END AS status FROM orders")
def csv_options(spark: SparkSession, d: str) -> DataFrame:
    """Decimal commas, another separator and quote, several texts for null, given names and types."""
    place, own = _place(spark, "csv"), _orders(spark, d)
    own = own.select(F.col("o_orderkey").alias("Order key"), F.translate(F.col("o_totalprice").cast("string"), ".", ",").alias("Price!"), "o_orderstatus")
    own.write.options(header=True, sep=";", quote="'").csv(place)
    read = readers.from_csv(spark, place, sep=";", quote="'", all_text=True, null_values=["P", "O"], decimal=",", kinds={"price": "double", "order_key": "bigint"}, plain_names=True)
    return read.toDF("o_orderkey", "price", "status")


@query("SELECT count(*) FILTER (n_regionkey IN (1, 2)) AS good, count(*) FILTER (n_regionkey NOT IN (1, 2)) AS bad FROM nation")
def csv_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Lines that don't fit their schema are kept aside."""
    place = _place(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey").isin(1, 2), F.col("n_regionkey").cast("string")).otherwise("no number").alias("r")).write.csv(place)
    read = cut_lineage(readers.from_csv(spark, place, header=False, columns={"k": "bigint", "r": "bigint"}, rejects="line"))
    return read.agg(F.count_if(F.col("line").isNull()).alias("good"), F.count_if(F.col("line").isNotNull()).alias("bad"))


@query("SELECT r_regionkey, r_name FROM region")
def csv_in_memory(spark: SparkSession, d: str) -> DataFrame:
    lines = [f"{r['r_regionkey']},{r['r_name']}" for r in table(spark, d, "region").collect()]  # 5 rows
    return readers.from_csv(spark, StringIO("\n".join(["r_regionkey,r_name", *lines])), columns={"r_regionkey": "int", "r_name": "string"})


@query(_SUPPLIERS)
def replaced_table(spark: SparkSession, d: str) -> DataFrame:
    """A table is replaced; what a write that fails leaves is the table as it was, and a write that must not find one refuses."""
    with catalog.scratch_database(spark) as db:
        name, own = f"{db}.suppliers", _suppliers(spark, d)
        sinks.into_table(own.limit(3), name)
        sinks.into_table(own, name, sinks.REPLACE)
        for bad in (lambda: sinks.into_table(own, name), lambda: sinks.into_table(own.withColumn("s_suppkey", F.raise_error(F.lit("broken")).cast("bigint")), name, sinks.REPLACE)):
            try:
                bad()
            except Exception:  # noqa: BLE001
                continue
            raise AssertionError("the write should have failed")
        return cut_lineage(spark.table(name))


@query("SELECT (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM nation) AS nations, 2 AS tables")
def tables_together(spark: SparkSession, d: str) -> DataFrame:
    """Two tables appear together; of a group in which one fails neither does."""
    with catalog.scratch_database(spark) as db:
        with sinks.transaction(spark) as t:
            t.write(_suppliers(spark, d), f"{db}.a")
            t.write(table(spark, d, "nation"), f"{db}.b")
        try:
            with sinks.transaction(spark) as t:
                t.write(_suppliers(spark, d), f"{db}.c")
                raise RuntimeError("stop")
        except RuntimeError:
            pass
        found = (spark.table(f"{db}.a").count(), spark.table(f"{db}.b").count(), sum(not t.isTemporary for t in spark.catalog.listTables(db)))
    return spark.createDataFrame([found], "suppliers long, nations long, tables int")


@query(_SUPPLIERS)
def function_sink(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "sink")
    sinks.into_function(_suppliers(spark, d), lambda df: df.write.parquet(place))
    return spark.read.parquet(place)


@query(_SUPPLIERS)
def copied_source(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "copy")
    return sinks.copy(_suppliers(spark, d), lambda df: sinks.into_parquet(df, place)).join(spark.read.parquet(place), ["s_suppkey", "s_name"])


@query("SELECT s_suppkey, s_name FROM supplier")
def created_table(spark: SparkSession, d: str) -> DataFrame:
    with catalog.scratch_database(spark) as db:
        own, name = _suppliers(spark, d), f"{db}.suppliers"
        if catalog.exists(spark, name):
            raise AssertionError("too early")
        catalog.create_table(spark, name, own.schema)
        catalog.create_table(spark, name, own.schema, "ignore")
        if not catalog.exists(spark, name):
            raise AssertionError("not created")
        sinks.into_table(own, name, sinks.APPEND, create=False)
        return cut_lineage(spark.table(name))


@query("SELECT c_mktsegment, count(*) AS orders, 8 AS buckets FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def bucketed_join(spark: SparkSession, d: str) -> DataFrame:
    """Tables laid out by the key of their join."""
    with catalog.scratch_database(spark) as db:
        sinks.into_table(table(spark, d, "orders").select("o_custkey"), f"{db}.o", bucket_by=(8, "o_custkey"))
        sinks.into_table(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), f"{db}.c", bucket_by=(8, "c_custkey"))
        buckets, _ = sinks.layout(spark, f"{db}.o")
        joined = spark.table(f"{db}.o").join(spark.table(f"{db}.c"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("orders"))
        return cut_lineage(joined.withColumn("buckets", F.lit(buckets)))


@query("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def attached_database(spark: SparkSession, d: str) -> DataFrame:
    name = f"attached_{uuid.uuid4().hex[:12]}"
    if not {"nation", "region"} <= set(catalog.attach(spark, name, d)) or name not in catalog.databases(spark):
        raise AssertionError("tables are missing")
    try:
        return cut_lineage(Engine.create(spark).sql(f"SELECT r_name, count(*) AS nations FROM {name}.nation JOIN {name}.region ON n_regionkey = r_regionkey GROUP BY 1"))
    finally:
        catalog.detach(spark, name)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > 10")
def isolated_session(spark: SparkSession, d: str) -> DataFrame:
    """A session of its own: its views are hidden from others; its rows come back through a table."""
    with catalog.scratch_database(spark) as db:
        own = Engine.create(spark).isolated(db)
        own.spark.read.parquet(f"{d}/supplier.parquet").createOrReplaceTempView("only_here")
        if spark.catalog.tableExists("only_here"):
            raise AssertionError("the view is seen from outside")
        own.save(own.sql("SELECT s_suppkey, s_name FROM only_here WHERE s_suppkey > :least", {"least": 10}), "kept")
        return cut_lineage(Engine.create(spark).table(f"{db}.kept"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    own = _orders(spark, d)
    return readers.beside(own.select("o_orderkey", "o_custkey"), own.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")


@query(f"{_ORDERS} ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def slice_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.by_places(_orders(spark, d), "o_orderkey", 1000, 500)


@query(f"{_ORDERS} ORDER BY o_orderkey OFFSET 100")
def skip_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.by_places(_orders(spark, d), "o_orderkey", 100)


@query("SELECT o_orderkey, o_orderstatus, 3 AS declared FROM orders")
def restored_enum(spark: SparkSession, d: str) -> DataFrame:
    """An enum's values, lost in a CSV file, come back with the schema."""
    place, schema = _place(spark, "csv"), T.StructType([types.field("o_orderkey", "int64"), types.enum_field("o_orderstatus", ["F", "O", "P"])])
    sinks.into_csv(_orders(spark, d).select("o_orderkey", "o_orderstatus"), place)
    back = types.restore_types(readers.from_csv(spark, place, all_text=True), types.from_text(types.to_text(schema)))
    return back.withColumn("declared", F.lit(len(back.schema["o_orderstatus"].metadata["enum"])))


@query("SELECT k.place, k.c_custkey, c_mktsegment FROM (SELECT unnest(range(5)) AS place, unnest([7, 3, 7, 999999999, 12]) AS c_custkey) k LEFT JOIN customer c ON c.c_custkey = k.c_custkey")
def lookup_many(spark: SparkSession, d: str) -> DataFrame:
    """Given keys in their order: repeated ones repeat, unknown ones have nulls."""
    rows = joins.Lookup("customer", table(spark, d, "customer"), "c_custkey", ("c_mktsegment",)).get_batch([7, 3, 7, 999_999_999, 12]).collect()
    return spark.createDataFrame([(i, r["c_custkey"], r["c_mktsegment"]) for i, r in enumerate(rows)], "place long, c_custkey long, c_mktsegment string")


@query("SELECT CAST(row_number() OVER (ORDER BY t, n) - 1 AS BIGINT) AS place, t AS \"table\", n AS name FROM (VALUES ('b', 'late'), ('a', 'second'), ('b', 'early'), ('a', 'first')) v(t, n)")
def strategies_by_table(spark: SparkSession, d: str) -> DataFrame:
    """Strategies are grouped whatever their order, and a list again."""
    made = [(t, joins.Lookup(n, table(spark, d, "customer"), "c_custkey", ())) for t, n in (("b", "late"), ("a", "second"), ("b", "early"), ("a", "first"))]
    return spark.createDataFrame([(i, t, s.name) for i, (t, s) in enumerate(joins.flat(joins.by_table(made)))], "place long, table string, name string")


@query("""
SELECT '## region' || chr(10) || chr(10) || '| column | type |' || chr(10) || '| --- | --- |' || chr(10) || '| r_regionkey | int |' || chr(10) || '| r_name | string |' || chr(10) || chr(10)
  || 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS text FROM region""")
def schema_text(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(markdown_schema(region, "region"),)], "text string")


@query('SELECT o_orderkey AS "key `of` it" FROM orders')
def quoted_names(spark: SparkSession, d: str) -> DataFrame:
    odd = table(spark, d, "orders").select(F.col("o_orderkey").alias("key `of` it"))
    return odd.select(F.col(catalog.quoted("key `of` it")))


_H = hash_sql("o_orderkey")


@query(f"""
WITH t AS (SELECT o_orderkey, {_H} AS h FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY h % 1000 < 800 ORDER BY h, o_orderkey) AS r FROM t)
SELECT o_orderkey, h % 1000 < 800 AS _is_train, h % 1000 < 800 AND r <= 10000 AS _is_feature_search, h % 1000 < 800 AND r <= 100000 AS _is_feature_eval FROM r""")
def engine_split(spark: SparkSession, d: str) -> DataFrame:
    return Engine.create(spark).split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders")
def split_flags_dropped(spark: SparkSession, d: str) -> DataFrame:
    return split.drop_flags(split.split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 0.8, 300, 900))


@query(f"SELECT o_orderkey FROM orders ORDER BY {_H}, o_orderkey LIMIT 12000")
def sample_many(spark: SparkSession, d: str) -> DataFrame:
    return sampling.uniform(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 12_000)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 12000")
def head_many(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 12_000)
