"""Splits and samples."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import sampling, split
from driftloom.plans.common import hash_sql
from driftloom.plans.registry import query
from driftloom.session import table

_H = hash_sql("o_orderkey")
_FLAGS_SQL = f"""
WITH h AS (SELECT o_orderkey, {_H} AS h FROM orders),
t AS (SELECT *, h % 1000 < 800 AS _is_train, row_number() OVER (PARTITION BY h % 1000 < 800 ORDER BY h, o_orderkey) AS r FROM h)
SELECT o_orderkey, _is_train, _is_train AND r <= 300 AS _is_feature_search, _is_train AND r <= 900 AS _is_feature_eval FROM t"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return split.split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, 300, 900)


@query(_FLAGS_SQL)
def split_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d)


@query(f"SELECT count(*) AS rows, count(*) FILTER (_is_train) AS train_rows, count(*) FILTER (_is_feature_search) AS feature_search_rows, count(*) FILTER (_is_feature_eval) AS feature_eval_rows FROM ({_FLAGS_SQL})")
def split_shares(spark: SparkSession, d: str) -> DataFrame:
    return split.shares(_flagged(spark, d))


@query(f"SELECT o_orderkey FROM ({_FLAGS_SQL}) WHERE _is_feature_search")
def split_search_subset(spark: SparkSession, d: str) -> DataFrame:
    return split.part(_flagged(spark, d), "feature_search")


@query(f"SELECT o_orderkey FROM ({_FLAGS_SQL}) WHERE NOT _is_train")
def split_test(spark: SparkSession, d: str) -> DataFrame:
    return split.part(_flagged(spark, d), "test")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def head_rows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head(table(spark, d, "orders"), "o_orderkey", 100)


@query("SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def tail_rows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.tail(table(spark, d, "orders"), "o_orderkey", 100)


_START = random.Random(42).randint(0, 20)


@query(f"SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET {_START}")
def random_start_rows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_start(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 5)


@query(f"SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {_H}, o_orderkey LIMIT 500")
def sample_random(spark: SparkSession, d: str) -> DataFrame:
    return sampling.uniform(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 500)


@query(f"""
WITH c AS (SELECT o_orderstatus AS s, greatest(1, CAST(round_even(400.0 * count(*) / (SELECT count(*) FROM orders), 0) AS BIGINT)) AS q FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderstatus FROM orders JOIN c ON s = o_orderstatus
QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey) <= q""")
def sample_prop_class(spark: SparkSession, d: str) -> DataFrame:
    return sampling.by_class(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 400)


@query(f"""
SELECT o_orderkey, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H}, o_orderkey) <= 403 // (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def sample_bal_class(spark: SparkSession, d: str) -> DataFrame:
    return sampling.by_class(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 403, balanced=True)


@query(f"""
WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
b AS (SELECT *, CAST(pos >= n // 5 AS INT) + CAST(pos >= 2 * n // 5 AS INT) + CAST(pos >= 3 * n // 5 AS INT) + CAST(pos >= 4 * n // 5 AS INT) AS bin FROM p)
SELECT o_orderkey, o_totalprice FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY {_H}, o_orderkey) <= CASE WHEN bin < 3 THEN 81 ELSE 80 END""")
def sample_prop_numeric(spark: SparkSession, d: str) -> DataFrame:
    return sampling.by_range(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 403)


@query(f"""
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT o_orderkey, o_totalprice, least(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 5)), 1), 5) AS bin FROM orders, e)
SELECT o_orderkey, o_totalprice FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY {_H}, o_orderkey) <= 80""")
def sample_bal_numeric(spark: SparkSession, d: str) -> DataFrame:
    return sampling.by_range(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 403, balanced=True)


@query(f"SELECT outcome, conversation_id FROM conversations WHERE outcome IS NOT NULL AND conversation_id IS NOT NULL GROUP BY outcome, conversation_id QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY {hash_sql('conversation_id')}, conversation_id) <= 40 // (SELECT count(DISTINCT outcome) FROM conversations WHERE conversation_id IS NOT NULL)")
def sample_bal_outcome(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "conversations").where("outcome IS NOT NULL AND conversation_id IS NOT NULL").select("outcome", "conversation_id").distinct()
    return sampling.by_class(own, "conversation_id", "outcome", 40, balanced=True)
