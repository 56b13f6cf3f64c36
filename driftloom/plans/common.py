"""Tables and expressions that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators.joins import Conversations
from driftloom.session import broadcast_if_small, table


def hash_sql(key: str, seed: int = 42) -> str:
    """The portable hash in DuckDB."""
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 15) AS BIGINT)"


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Timed messages with usable senders: msg_id, dialogue_id, sent_at, role, text."""
    forms = table(spark, d, "sender_forms").select(F.col("sender_form").alias("_f"), F.col("participant").alias("role"))
    own = table(spark, d, "turns").where("sent_at IS NOT NULL AND dialogue_id IS NOT NULL AND text IS NOT NULL").withColumn("_f", F.lower(F.trim("sender")))
    return own.join(broadcast_if_small(forms), "_f").select("msg_id", "dialogue_id", "sent_at", "role", "text")


MESSAGES_SQL = """messages AS (
  SELECT msg_id, dialogue_id, sent_at, participant AS role, text FROM turns JOIN sender_forms ON lower(trim(sender, ' ')) = sender_form
  WHERE sent_at IS NOT NULL AND dialogue_id IS NOT NULL AND text IS NOT NULL)"""


def talks(spark: SparkSession, d: str) -> Conversations:
    return Conversations("talks", messages(spark, d), "dialogue_id", "sent_at", "role", "text", "msg_id")
