"""The queries of the problems tagged llm, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import conversations, mixing, packing, pairs, pii, target_sample, truncation
from driftloom.llm.textunits import with_token_counts
from driftloom.session import cut_lineage, small_rows, spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(spread(table(spark, d, "responses").select("pair_id", "prompt", "response", "should_respond"), "pair_id"), "pair_id", "prompt", "response", "should_respond")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(_documents(spark, d, "source"), "doc_id", "text", "source").select("doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_report(_documents(spark, d, "source"), "doc_id", "text", "source")


def _fields(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "outcome": cut_lineage(target_sample.eligible(table(spark, d, "conversations"), "conversation_id", "outcome")),
        "churn_status": cut_lineage(target_sample.eligible(table(spark, d, "telco_main"), "customer_id", "churn_status")),
    }


def _reports(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    targets = table(spark, d, "sample_targets")
    return {f: (rows, target_sample.quota_report(rows, targets.where(F.col("target_field") == f))) for f, rows in _fields(spark, d).items()}


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "turns").select("msg_id", "text"), "msg_id")


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", *columns, "text"), "doc_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (target_sample.sample_report(*x).where("short").select("target_field", "category") for x in _reports(spark, d).values())
    return a.unionByName(b)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    a, b = (target_sample.sample_report(*x) for x in _reports(spark, d).values())
    return a.unionByName(b).withColumn("wanted", F.round("wanted", 6)).drop("missed")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    a, b = (target_sample.draw(rows, r).select(F.lit(f).alias("target_field"), "category", "id") for f, (rows, r) in _reports(spark, d).items())
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.kinds_found(_turns(spark, d), "msg_id", "text", table(spark, d, "name_list"))


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(_turns(spark, d), "msg_id", "text", table(spark, d, "name_list"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dropped_dialogues(table(spark, d, "turns"), table(spark, d, "sender_forms"))


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "turns"), table(spark, d, "sender_forms"))


def _sized(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return with_token_counts(_documents(spark, d, *columns), "text", "tokens").drop("text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    limits = [(r["limit_name"], r["capacity_tokens"]) for r in small_rows(table(spark, d, "pack_limits"))]
    return packing.pack(_sized(spark, d), "doc_id", "tokens", limits).withColumnRenamed("item", "doc_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("parts > 1 AND part = 0").select("limit_name", "doc_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any right packing: nothing lost or split without need, nothing overfull, next to no container too many."""
    packed = _packed(spark, d)
    documents = packed.groupBy("limit_name").agg(F.count_if(F.col("part") == 0).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("part") == 0)).alias("split"))
    bins = packed.groupBy("limit_name", "capacity", "container").agg(F.sum("tokens").alias("fill")).groupBy("limit_name", "capacity").agg(
        F.sum("fill").alias("tokens"), F.count_if(F.col("fill") > F.col("capacity")).alias("overfull"), F.count("*").alias("_n"), F.ceil(F.sum("fill") / F.col("capacity")).alias("least_containers")
    )
    return bins.join(documents, "limit_name").select("limit_name", "capacity", "tokens", "documents", "split", "overfull", "least_containers", (F.col("_n") <= 1.02 * F.col("least_containers") + 1).alias("close"))


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # counted once; the plan and the mix read the sizes only
    sized = cut_lineage(_sized(spark, d, "source"))
    return sized, mixing.source_plan(sized, table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    sized, plan = _plan(spark, d)
    return mixing.mix_report(mixing.mix(sized, plan), plan).where("NOT reached").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_plan(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    sized, plan = _plan(spark, d)
    return mixing.mix_report(mixing.mix(sized, plan), plan).select("source", "target_share", "tokens", F.round("needed", 3).alias("needed"), "reached", "used_tokens", "used_documents", "actual_share", "budget_share")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p3_found, p3_report, p3_sample, p4_found, p4_masked, p5_found, p5_conversations, p6_found, p6_containers, p6_report, p6_totals, p7_found, p7_mix, p7_report, p8_found, p8_report)}


def oracle_sql() -> dict[str, str]:
    from driftloom.llm.oracles import SQL

    return dict(SQL)
