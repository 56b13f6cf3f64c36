"""Conversations from message rows: order, roles, sessions, and which dialogues to drop.

A dialogue may hold any share of all rows, so no dialogue is ever sorted or collected as a whole. Messages are grouped by
(dialogue, time block); order and gaps are found inside the blocks, and only one row per block is carried over the dialogue.

Defined cases: blank messages are left out of the conversation but their dialogue is still judged; messages without a
dialogue id belong to no dialogue; a message delivered twice (same dialogue, sender, time and text) counts once, under its
least msg_id; equal times keep the order of msg_id; msg_ids must be unique, nulls stand for
messages without one. An empty table gives empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.llm.textunits import is_blank, trimmed
from driftloom.session import broadcast_if_small, cut_lineage

#: Bins of the gap histogram for each doubling of the gap.
BINS_PER_OCTAVE = 4


def with_roles(turns: DataFrame, sender_forms: DataFrame) -> DataFrame:
    """Messages with ``_role`` (null: unusable sender), ``_blank`` and ``_block`` (the hour; null without a time)."""
    forms = sender_forms.select(F.lower(trimmed(F.col("sender_form"))).alias("_form"), F.lower(trimmed(F.col("participant"))).alias("_role")).dropDuplicates(["_form"])
    own = turns.where(F.col("dialogue_id").isNotNull()).select(
        "msg_id", "dialogue_id", "sent_at", "text",
        F.lower(trimmed(F.col("sender"))).alias("_form"), is_blank(F.col("text")).alias("_blank"), F.date_trunc("hour", "sent_at").alias("_block"),
    )
    return own.join(broadcast_if_small(forms), "_form", "left").drop("_form")


def _placed(messages: DataFrame) -> DataFrame:
    """Usable messages, each once, with their place and gap inside the block."""
    keys = ["dialogue_id", "_block"]
    usable = messages.where(~F.col("_blank") & F.col("_role").isNotNull() & F.col("sent_at").isNotNull())
    # partitioned by the block once: removing repeats and the order inside the block reuse it
    once = usable.repartition(*keys).groupBy(*keys, "sent_at", "_role", "text").agg(F.min("msg_id").alias("msg_id"))
    inside, at = W.partitionBy(*keys).orderBy("sent_at", "msg_id"), _micros("sent_at")
    return once.withColumn("_place", F.row_number().over(inside)).withColumn("_gap", at - F.lag(at).over(inside))


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _blocks(placed: DataFrame) -> DataFrame:
    """One row per (dialogue, block): messages before it, and the silence before its first message."""
    keys = ["dialogue_id", "_block"]
    sums = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("sent_at").alias("_first"), F.max("sent_at").alias("_last"))
    before = W.partitionBy("dialogue_id").orderBy("_block")
    earlier = F.coalesce(F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("_before", earlier).withColumn("_previous", F.lag("_last").over(before)).select(*keys, "_before", (_micros("_first") - _micros("_previous")).alias("_step"))


def _numbered(placed: DataFrame, blocks: DataFrame, gap: int) -> DataFrame:
    """Messages of the given blocks' dialogues with ``position`` in the dialogue and ``session_no``, both from 1."""
    keys = ["dialogue_id", "_block"]
    broken = placed.withColumn("_cut", F.coalesce((F.col("_gap") > gap).cast("int"), F.lit(0)))
    cuts = broken.groupBy(*keys).agg(F.sum("_cut").alias("_cuts"))
    before = W.partitionBy("dialogue_id").orderBy("_block")
    starts = blocks.join(cuts, keys).withColumn("_new", F.coalesce((F.col("_step") > gap).cast("int"), F.lit(0)))
    starts = starts.select(*keys, "_before", (F.sum("_new").over(before) + F.coalesce(F.sum("_cuts").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).alias("_session"))
    inside = W.partitionBy(*keys).orderBy("_place")
    return broken.withColumn("_inner", F.sum("_cut").over(inside)).join(starts, keys).select(
        "dialogue_id", (F.col("_before") + F.col("_place")).cast("bigint").alias("position"), (F.col("_session") + F.col("_inner")).cast("bigint").alias("session_no"),
        F.col("_role").alias("role"), "sent_at", "text", "msg_id",
    )


def _sessionized(turns: DataFrame, sender_forms: DataFrame, max_gap_micros: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(all messages, usable ones with position and session_no, the gap). Of the texts only hashes are kept, to tell repeats."""
    messages = with_roles(turns, sender_forms).withColumn("text", F.xxhash64("text"))
    placed = cut_lineage(_placed(messages))
    blocks = _blocks(placed)
    gap = gap_threshold(placed, blocks) if max_gap_micros is None else max_gap_micros
    return messages, _numbered(placed, blocks, gap), gap


def _sessions(messages: DataFrame, numbered: DataFrame) -> DataFrame:
    talks = numbered.groupBy("dialogue_id", "session_no").agg(
        F.count("*").alias("messages"), F.min(F.when(F.col("role") == "customer", F.col("sent_at"))).alias("first_customer"),
        F.max(F.when(F.col("role") == "agent", F.col("sent_at"))).alias("last_agent"), F.max(F.col("role").isin("agent", "customer")).alias("spoken"),
    ).withColumn("unusable", F.lit(False))
    bad = ~F.col("_blank") & (F.col("_role").isNull() | F.col("sent_at").isNull())
    never = F.lit(None).cast("timestamp_ntz")
    rest = messages.groupBy("dialogue_id").agg(F.count_if(F.col("_blank") | bad).alias("messages"), F.max(bad).alias("unusable"))
    rest = rest.select("dialogue_id", F.lit(0).cast("bigint").alias("session_no"), "messages", never.alias("first_customer"), never.alias("last_agent"), F.lit(False).alias("spoken"), "unusable")
    return talks.unionByName(rest).withColumn("replied", F.coalesce(F.col("last_agent") > F.col("first_customer"), F.lit(False)))


def sessions(turns: DataFrame, sender_forms: DataFrame, max_gap_micros: int | None = None) -> DataFrame:
    """One row per session of each dialogue: messages, first_customer, last_agent, replied (reciprocal: an agent after a customer).

    ``session_no`` 0 stands for the messages that can't be placed, blank or unusable; every dialogue has it. ``unusable``:
    some message of it isn't blank.
    """
    return _sessions(*_sessionized(turns, sender_forms, max_gap_micros)[:2])


def _dropped(judged: DataFrame) -> DataFrame:
    facts = judged.groupBy("dialogue_id").agg(
        F.max("unusable").alias("unusable"), F.max("spoken").alias("spoken"), F.max("replied").alias("replied"), F.min("first_customer").alias("first_customer"), F.max("last_agent").alias("last_agent")
    )
    # dialogues without any session that was replied to are candidates; a reply in a later session saves them
    later = F.coalesce(F.col("last_agent") > F.col("first_customer"), F.lit(False))
    defect = F.when(F.col("unusable"), "broken").when(~F.col("spoken"), "empty").when(~F.col("replied") & ~later, "no_reply")
    return facts.select("dialogue_id", defect.alias("defect")).where("defect IS NOT NULL")


def dropped_dialogues(turns: DataFrame, sender_forms: DataFrame, max_gap_micros: int | None = None) -> DataFrame:
    """(dialogue_id, defect) of every dialogue to be dropped: ``broken``, ``empty`` or ``no_reply``, the first that applies.

    Judged from its sessions: one with a reciprocal reply keeps its dialogue; without any, a reply may still come in a later
    session than the question.
    """
    return _dropped(sessions(turns, sender_forms, max_gap_micros))


def gap_threshold(placed: DataFrame, blocks: DataFrame) -> int:
    """Microseconds of silence that end a session, calibrated on all gaps.

    The gaps' logarithms fall into two clusters of very unequal size, pauses inside a talk and silence between talks; the
    threshold is the cut of minimum classification error under a normal model of each. Only the histogram, of
    bounded size, reaches the driver.
    """
    gaps = placed.select(F.col("_gap").alias("gap")).unionByName(blocks.select(F.col("_step").alias("gap")))
    bins = gaps.where("gap > 0").groupBy(F.floor(F.log2("gap") * BINS_PER_OCTAVE).cast("int").alias("bin")).count().collect()
    return cut_between_clusters(sorted((r["bin"], r["count"]) for r in bins))


def cut_between_clusters(counts: list[tuple[int, int]]) -> int:
    """The gap at the cut of minimum error in a histogram of log gaps; without two clusters, beyond all gaps."""

    def cost(part: list[tuple[int, int]], whole: int) -> float:
        n = sum(c for _, c in part)
        mean = sum(b * c for b, c in part) / n
        spread = sum((b - mean) ** 2 * c for b, c in part) / n + 1 / 12
        return n / whole * (math.log(spread) - 2 * math.log(n / whole))

    whole = sum(c for _, c in counts)
    costs = [(cost(counts[:i], whole) + cost(counts[i:], whole), i) for i in range(1, len(counts))]
    if not costs or min(costs)[0] >= cost(counts, whole):
        return 2**62
    i = min(costs)[1]
    return int(2 ** ((counts[i - 1][0] + 1 + counts[i][0]) / 2 / BINS_PER_OCTAVE))


def rebuild(turns: DataFrame, sender_forms: DataFrame, max_gap_micros: int | None = None, replied_only: bool = False) -> DataFrame:
    """Messages of all whole conversations: dialogue_id, position (from 1), session_no (from 1), session_replied, role, sent_at, text, msg_id.

    ``session_replied`` tells the sessions with a reciprocal reply; ``replied_only`` drops the messages of all others, which
    leaves parts of conversations.
    """
    messages, numbered, _ = _sessionized(turns, sender_forms, max_gap_micros)
    numbered = cut_lineage(numbered.withColumnRenamed("text", "_h"))
    judged = cut_lineage(_sessions(messages, numbered))
    # sessions and dialogues are joined before the messages, of which a dialogue may hold any share; AQE splits such a key
    kept = judged.where("session_no > 0").join(_dropped(judged), "dialogue_id", "left_anti").select("dialogue_id", "session_no", F.col("replied").alias("session_replied"))
    if replied_only:
        kept = kept.where("session_replied")
    # each text is shuffled once, to its message; messages without an id are told by dialogue, time and text
    found = numbered.join(kept, ["dialogue_id", "session_no"])
    nameless = turns.where("msg_id IS NULL").select("dialogue_id", "sent_at", "text", F.xxhash64("text").alias("_h")).dropDuplicates(["dialogue_id", "sent_at", "_h"])
    rows = found.join(turns.select("msg_id", "text"), "msg_id").unionByName(found.where("msg_id IS NULL").join(nameless, ["dialogue_id", "sent_at", "_h"]))
    return rows.select("dialogue_id", "position", "session_no", "session_replied", "role", "sent_at", "text", "msg_id")
