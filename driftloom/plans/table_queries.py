"""Projections, filters, casts, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import joins
from driftloom.operators.analyze import classes_of, target_violations
from driftloom.operators.cache import cache_key, evict, missing_from
from driftloom.operators.features import OTHER, Feature
from driftloom.plans.common import MESSAGES_SQL, hash_sql, messages, talks
from driftloom.plans.registry import query
from driftloom.session import placed, table
from driftloom.sources import readers
from driftloom.sources.catalog import alter_types


@query("SELECT o_orderkey, o_totalprice FROM orders")
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice")


@query("SELECT * EXCLUDE (o_orderpriority, o_orderdate) FROM orders")
def drop_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").drop("o_orderpriority", "o_orderdate")


@query("SELECT event_id, TRY_CAST(event_type AS BIGINT) AS as_int, TRY_CAST(CAST(round(value, 2) AS VARCHAR) AS DOUBLE) AS as_double FROM events")
def cast_nonstrict(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select("event_id", F.col("event_type").alias("as_int"), F.round("value", 2).cast("string").alias("as_double"))
    return alter_types(df, {"as_int": "bigint", "as_double": "double"}, invalid_to_null=True)


@query("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def cast_strict(spark: SparkSession, d: str) -> DataFrame:
    return alter_types(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), {"o_custkey": "int", "o_orderdate": "date"})


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey = 7")
def lookup_point(spark: SparkSession, d: str) -> DataFrame:
    found = joins.Lookup("customer", table(spark, d, "customer"), "c_custkey", ("c_custkey", "c_mktsegment", "c_acctbal")).get(7)
    return spark.createDataFrame([found] if found else [], "c_custkey long, c_mktsegment string, c_acctbal double")


@query("SELECT o_orderkey, o_custkey, c_mktsegment, c_acctbal, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_left_ordered(spark: SparkSession, d: str) -> DataFrame:
    by_customer = joins.Lookup("customer", table(spark, d, "customer"), "c_custkey", ("c_mktsegment", "c_acctbal", "c_nationkey"))
    return by_customer.batch(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


_SERIES_SQL = """
SELECT c_custkey, e.ts AS at, event_type, value, event_id, EXISTS (SELECT 1 FROM events k WHERE k.user_id = c_custkey) AS key_exists
FROM customer LEFT JOIN events e ON user_id = c_custkey AND ts {ge} TIMESTAMP '2024-01-05' AND ts {le} TIMESTAMP '2024-01-12'"""


def _series(spark: SparkSession, d: str, start: bool, end: bool, cap: int | None = None) -> DataFrame:
    series = joins.TimeSeries("events", table(spark, d, "events"), "user_id", "ts", ("event_type", "value", "event_id"))
    window = joins.Window("TIMESTAMP_NTZ '2024-01-05'", "TIMESTAMP_NTZ '2024-01-12'", start, end, cap)
    return series.rows(table(spark, d, "customer").select("c_custkey"), "c_custkey", window, "event_id")


@query(_SERIES_SQL.format(ge=">=", le="<"))
def kts_range_window(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d, True, False)


@query(_SERIES_SQL.format(ge=">", le="<="))
def kts_range_flags(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d, False, True)


@query(f"SELECT * FROM ({_SERIES_SQL.format(ge='>=', le='<')}) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {hash_sql('event_id')} NULLS FIRST, event_id) <= 2")
def kts_sampled_cap(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d, True, False, 2)


@query("""
SELECT c_custkey, CASE WHEN max(CAST(key_exists AS INT)) = 1 THEN count("at") END AS points, min("at") AS first_at, max("at") AS last_at
FROM (""" + _SERIES_SQL.format(ge=">=", le="<") + """) GROUP BY c_custkey""")
def kts_series_arrays(spark: SparkSession, d: str) -> DataFrame:
    series = joins.TimeSeries("events", table(spark, d, "events"), "user_id", "ts", ("value",))
    window = joins.Window("TIMESTAMP_NTZ '2024-01-05'", "TIMESTAMP_NTZ '2024-01-12'", True, False)
    got = series.series(table(spark, d, "customer").select("c_custkey"), "c_custkey", window)
    return got.select("c_custkey", F.when(F.col("series").isNotNull(), F.size("series").cast("bigint")).alias("points"), F.get("series", F.lit(0))["at"].alias("first_at"), F.element_at(F.when(F.size("series") > 0, F.col("series")), -1)["at"].alias("last_at"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AS key_exists FROM customer")
def kts_key_exists(spark: SparkSession, d: str) -> DataFrame:
    return joins.TimeSeries("events", table(spark, d, "events"), "user_id", "ts", ("value",)).exist(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("""
WITH m AS (SELECT DISTINCT customer_id, reference_date FROM telco_main WHERE customer_id IS NOT NULL AND reference_date IS NOT NULL)
SELECT m.customer_id, m.reference_date, count(b.bill_id) AS bills, round(coalesce(sum(amount_due), 0), 4) AS due, max(bill_date) AS last_bill
FROM m LEFT JOIN billing_history b ON b.customer_id = m.customer_id AND bill_date >= m.reference_date - INTERVAL 90 DAY AND bill_date < m.reference_date
GROUP BY ALL""")
def kts_row_windows(spark: SparkSession, d: str) -> DataFrame:
    main = table(spark, d, "telco_main").where("customer_id IS NOT NULL AND reference_date IS NOT NULL").select("customer_id", "reference_date").distinct()
    bills = joins.TimeSeries("bills", table(spark, d, "billing_history").withColumnRenamed("customer_id", "payer"), "payer", "bill_date", ("bill_id", "amount_due"))
    rows = bills.rows(main, "customer_id", joins.Window("reference_date - INTERVAL 90 DAY", "reference_date", True, False))
    return rows.groupBy("customer_id", "reference_date").agg(F.count("bill_id").alias("bills"), F.round(F.coalesce(F.sum("amount_due"), F.lit(0.0)), 4).alias("due"), F.max("at").alias("last_bill"))


@query(f"""
WITH {MESSAGES_SQL},
l AS (SELECT dialogue_id, sent_at, msg_id, upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text AS line FROM messages),
c AS (SELECT dialogue_id, sent_at, msg_id, CASE WHEN row_number() OVER w > 1 THEN chr(10) ELSE '' END || line AS piece,
  CAST(coalesce(sum(length(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS BIGINT) AS chunk_no FROM l WINDOW w AS (PARTITION BY dialogue_id ORDER BY sent_at, msg_id))
SELECT i.conversation_id, chunk_no, string_agg(piece, '' ORDER BY sent_at, msg_id) AS lines
FROM (SELECT DISTINCT conversation_id FROM conversations WHERE conversation_id IS NOT NULL) i LEFT JOIN c ON dialogue_id = conversation_id GROUP BY ALL""")
def conversation_assemble(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").where("conversation_id IS NOT NULL").select("conversation_id").distinct()
    chunks = talks(spark, d).chunks()
    return ids.join(chunks, F.col("conversation_id") == F.col("dialogue_id"), "left").select("conversation_id", "chunk_no", F.col("text").alias("lines"))


@query(f"WITH {MESSAGES_SQL} SELECT *, row_number() OVER (PARTITION BY dialogue_id ORDER BY sent_at, msg_id) - 1 AS position FROM messages")
def conversation_rows(spark: SparkSession, d: str) -> DataFrame:
    return talks(spark, d).rows()


@query(f"WITH {MESSAGES_SQL} SELECT DISTINCT conversation_id, EXISTS (SELECT 1 FROM messages WHERE dialogue_id = conversation_id) AS id_exists FROM conversations WHERE conversation_id IS NOT NULL")
def ids_exist(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").where("conversation_id IS NOT NULL").select("conversation_id").distinct()
    return talks(spark, d).exist(ids, "conversation_id")


@query("SELECT DISTINCT dialogue_id FROM turns WHERE dialogue_id IS NOT NULL AND dialogue_id NOT IN (SELECT conversation_id FROM conversations WHERE conversation_id IS NOT NULL)")
def ids_without_conversation(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "turns").where("dialogue_id IS NOT NULL").select("dialogue_id").distinct()
    return joins.only_without(ids, "dialogue_id", table(spark, d, "conversations"), "conversation_id")


@query("SELECT n_name AS left_n_name, r_name AS right_r_name FROM nation CROSS JOIN region")
def pair_space(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("_at"))
    b = table(spark, d, "region").select("r_name", F.col("r_regionkey").alias("_at"))
    return joins.pairs(a, b, 25, 5, 10_000)


_FLAT = joins.pair_positions(25, 25, 100).replace("L", "")


@query(f"""
WITH f AS (SELECT {_FLAT} AS flat FROM (SELECT unnest(range(100)) AS id))
SELECT a.n_name AS left_n_name, b.n_name AS right_n_name FROM f JOIN nation a ON a.n_nationkey = flat // 25 JOIN nation b ON b.n_nationkey = flat % 25""")
def pair_sample(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("_at"))
    return joins.pairs(n, n, 25, 25, 100)


@query("SELECT o_orderkey, o_orderkey - (SELECT min(o_orderkey) FROM orders) AS gap, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def row_index(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select("o_orderkey")
    low = own.agg(F.min("o_orderkey").alias("_low"))
    numbered = placed(own, ["o_orderkey"], {"row_index": None})
    return numbered.join(F.broadcast(low), F.lit(True)).select("o_orderkey", (F.col("o_orderkey") - F.col("_low")).alias("gap"), "row_index")


@query("SELECT count(*) AS rows, count(*) FILTER (churn_status IS NULL) AS missing, 0 AS not_finite FROM telco_main")
def target_validation(spark: SparkSession, d: str) -> DataFrame:
    return target_violations(table(spark, d, "telco_main"), "churn_status")


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_classes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in classes_of(table(spark, d, "orders"), "o_orderpriority")], "o_orderpriority string")


@query("SELECT event_id, CASE WHEN event_type = '' THEN NULL WHEN event_type NOT IN ('click', 'view') THEN '_other_' ELSE event_type END AS category FROM events")
def categorical_other(spark: SparkSession, d: str) -> DataFrame:
    kind = Feature("category", "category", "event_type", categories=("click", "view"))
    return table(spark, d, "events").select("event_id", kind.typed(F.col("event_type")).alias("category"))


@query("""
SELECT bill_id, CASE WHEN amount_due IS NULL THEN -7.0 WHEN amount_due < 0 THEN -1.0 ELSE round(amount_due, 4) END AS due
FROM billing_history""")
def defaults_substitution(spark: SparkSession, d: str) -> DataFrame:
    f = Feature("due", "float", "if(amount_due < 0, double('-infinity'), round(amount_due, 4))", default_missing=-7.0, default_nan=0.0, default_inf=1.0, default_neg_inf=-1.0)
    return table(spark, d, "billing_history").select("bill_id", f.with_defaults(f.typed(F.expr(f.expression))).alias("due"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def union_schema_checked(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return readers.union_all(a, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(lower(trim(text, ' ')))")
def text_dedup(spark: SparkSession, d: str) -> DataFrame:
    return joins.first_of_equal(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_filter(spark: SparkSession, d: str) -> DataFrame:
    return joins.only_with(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")


@query("SELECT p_type, count(*) AS n FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') OR p_size BETWEEN 10 AND 20 GROUP BY p_type")
def in_list_between(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23") | F.col("p_size").between(10, 20))
    return own.groupBy("p_type").agg(F.count("*").alias("n"))


@query("""
SELECT event_id FROM (SELECT event_id, sum(length(props)) OVER (ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS upto FROM events)
WHERE upto <= 20000""")
def lru_eviction(spark: SparkSession, d: str) -> DataFrame:
    return evict(table(spark, d, "events").where("ts IS NOT NULL").select("event_id", "ts", "props"), "ts", "props", "event_id", 20_000).select("event_id")


@query("SELECT count(*) AS prompts FROM (SELECT DISTINCT prompt FROM responses WHERE prompt IS NOT NULL AND participant = 'agent' EXCEPT SELECT prompt FROM responses WHERE participant = 'customer')")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "responses").where("prompt IS NOT NULL").select("participant", "prompt", cache_key(F.lit("model"), F.col("prompt")).alias("k"))
    return missing_from(own.where("participant = 'customer'"), own.where("participant = 'agent'").select("prompt", "k"), "k").agg(F.count("*").alias("prompts"))


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables of 25 and 5 rows
    by_customer = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    placed = by_customer.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return placed.groupBy("r_name", "n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query(f"""
WITH {MESSAGES_SQL}
SELECT msg_id, CAST(sent_at AS DATE) AS day, row_number() OVER (PARTITION BY dialogue_id, CAST(sent_at AS DATE) ORDER BY sent_at, msg_id) = 1 AS new_day FROM messages""")
def date_headers(spark: SparkSession, d: str) -> DataFrame:
    return joins.with_new_day(messages(spark, d), ["dialogue_id"], "sent_at", "msg_id").select("msg_id", "day", "new_day")
