"""Comparing simulated with real conversations: outcomes, lengths, pairs to judge, retrieval of similar prefixes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.hashing import portable_hash
from driftloom.operators import similar
from driftloom.operators.joins import with_next
from driftloom.session import placed, prefix_sums


def outcome_distribution(df: DataFrame, outcome: str) -> DataFrame:
    """(outcome, n, percent): shares of all conversations; those without outcome are one row with null."""
    counts = df.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return counts.join(F.broadcast(total), F.lit(True)).select("outcome", "n", (100 * F.col("n") / F.col("_all")).alias("percent"))


def compare_outcomes(real: DataFrame, simulated: DataFrame, outcome: str) -> DataFrame:
    """(outcome, real, simulated, ratio): every outcome of either side, zeros included."""
    a, b = (d.where(F.col(outcome).isNotNull()).groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias(n)) for d, n in ((real, "real"), (simulated, "simulated")))
    both = a.join(b, "outcome", "full_outer").select("outcome", F.coalesce("real", F.lit(0)).alias("real"), F.coalesce("simulated", F.lit(0)).alias("simulated"))
    return both.withColumn("ratio", F.try_divide("simulated", "real"))


def message_statistics(messages: DataFrame, conversation: str) -> DataFrame:
    """One row (conversations, shortest, longest, mean, median, deviation, mode) of messages per conversation.

    Median: the upper one. Deviation: of the population. Mode: the least among ties. Counted by length, of which there are few.
    """
    lengths = messages.groupBy(conversation).agg(F.count("*").alias("len")).groupBy("len").agg(F.count("*").alias("n"))
    total = lengths.agg(F.sum("n").alias("_all"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("_mean"))
    upto = lengths.withColumn("_to", F.sum("n").over(W.orderBy("len"))).join(F.broadcast(total), F.lit(True))
    return upto.agg(
        F.sum("n").alias("conversations"), F.min("len").alias("shortest"), F.max("len").alias("longest"), F.max("_mean").alias("mean"),
        F.min(F.when(F.col("_to") > F.floor(F.col("_all") / 2), F.col("len"))).alias("median"),
        F.sqrt(F.sum(F.col("n") * (F.col("len") - F.col("_mean")) * (F.col("len") - F.col("_mean"))) / F.sum("n")).alias("deviation"),
        F.max_by("len", F.struct("n", -F.col("len"))).alias("mode"),
    )


def accuracy(df: DataFrame, correct: Column) -> DataFrame:
    """(valid, correct, accuracy) over judgements that aren't null."""
    return df.agg(F.count(correct).alias("valid"), F.count_if(correct).alias("correct"), F.avg(correct.cast("int")).alias("accuracy"))


def prefix_lengths(messages: DataFrame, conversation: str, at: str, tie: str, role: str, content: str) -> DataFrame:
    """One row per message of any conversation: its place, the characters of the conversation up to it as text, and role and
    content of the next message.

    The prefix itself is the rows up to ``at_no`` of the conversation (``Conversations.rows``).
    """
    own = with_next(messages, [conversation], at, tie, [role, content]).withColumns({"_one": F.lit(1), "_line": F.length(_line(role, content)) + 1})
    numbered = prefix_sums(own, [conversation], at, ["_one", "_line"], ["at_no", "_from"], F.date_trunc("hour", F.col(at)), [tie])
    # each line but the last is followed by one more character
    return numbered.select(conversation, tie, F.col("at_no").cast("bigint").alias("at_no"), F.col(role).alias("role"), (F.col("_from") + F.col("_line") - 1).cast("bigint").alias("history_length"), F.col(f"next_{role}").alias("next_role"), F.col(f"next_{content}").alias("next_content"), F.col(f"next_{role}").isNull().alias("finished"))


def prefixes(messages: DataFrame, conversation: str, at: str, tie: str, role: str, content: str, size: int = 4096) -> DataFrame:
    """``prefix_lengths`` with the conversation up to each message as text, whatever its length: the texts of its chunks before
    ``chunk_no`` (``Conversations.chunks`` of the same ``size``), put together, and then ``tail``.

    All prefixes in full would grow with the square of a conversation's length; so each row holds ``size`` characters and a line at most.
    """
    line = _line(role, content)
    own = with_next(messages, [conversation], at, tie, [role, content]).withColumns({"_one": F.lit(1), "_line": F.length(line) + 1})
    numbered = prefix_sums(own, [conversation], at, ["_one", "_line"], ["at_no", "_from"], F.date_trunc("hour", F.col(at)), [tie])
    numbered = numbered.withColumn("chunk_no", F.floor(F.col("_from") / size))
    upto = W.partitionBy(conversation, "chunk_no").orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)
    piece = F.concat(F.when(F.col("at_no") > 0, "\n").otherwise(""), line)
    return numbered.select(
        conversation, tie, F.col("at_no").cast("bigint").alias("at_no"), F.col(role).alias("role"), "chunk_no", F.array_join(F.collect_list(piece).over(upto), "").alias("tail"),
        (F.col("_from") + F.col("_line") - 1).cast("bigint").alias("history_length"), F.col(f"next_{role}").alias("next_role"), F.col(f"next_{content}").alias("next_content"), F.col(f"next_{role}").isNull().alias("finished"),
    )


def _line(role: str, content: str) -> Column:
    return F.concat(F.initcap(role), F.lit(": "), F.col(content))


def dense_scenarios(df: DataFrame, order: str, keep: Column) -> DataFrame:
    """``df`` of the kept rows with ``scenario_id`` = scenario_0, scenario_1, … in the order of a unique key."""
    numbered = placed(df.where(keep), [order], {"_at": None})
    return numbered.withColumn("scenario_id", F.concat(F.lit("scenario_"), F.col("_at").cast("string"))).drop("_at")


def top_similar(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, keep: Column | None = None) -> DataFrame:
    """(query, key, score): the ``k`` rows of ``base`` most like each query by cosine, ties by key; the filter goes first.

    The exact search, for few queries and to measure ``similar.top_similar`` by, which asks an index: blocks of rows meet blocks of
    queries, both of bounded size, and each pair of blocks sends its best ``k`` only. Null vectors and vectors of zeros are left out.
    """
    first = queries.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    one_list = np.zeros((1, first[0] if first else 0))
    return similar.search(similar.index(base.where(keep) if keep is not None else base, key, vector, one_list), queries, key, vector, one_list if first else one_list[:0], k, 1)


def best_per_conversation(hits: DataFrame, query: str, conversation: str, score: str, tie: str) -> DataFrame:
    """Of each query's hits the best one of each conversation."""
    r = F.row_number().over(W.partitionBy(query, conversation).orderBy(F.desc(score), tie))
    return hits.withColumn("_r", r).where("_r = 1").drop("_r")


def simulate_turns(scenarios: DataFrame, key: str, opening: str, replies: Callable[[str, list[tuple[str, str]]], str | None], most: int = 20) -> DataFrame:
    """(key, at, role, content): conversations that alternate customer and agent until both pass in turn or ``most`` messages.

    ``replies(role, messages)`` gives the next message of a role or null to pass. Each scenario runs by itself in a partition.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for k, first in zip(pdf["key"], pdf["opening"]):
                said, passed, role = [("customer", first)], 0, "agent"
                while len(said) < most and passed < 2:
                    text = replies(role, said)
                    passed = passed + 1 if text is None else 0
                    if text is not None:
                        said.append((role, text))
                    role = "agent" if role == "customer" else "customer"
                rows += [(k, i, r, t) for i, (r, t) in enumerate(said)]
            yield pd.DataFrame(rows, columns=["key", "at", "role", "content"]).astype({"at": "int32"})

    own = scenarios.where(F.col(opening).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(opening).alias("opening"))
    return own.mapInPandas(run, "key string, at int, role string, content string")


def coin(key: Column, seed: int = 42) -> Column:
    """A seeded toss for each key, 0 or 1: which of two conversations is shown first."""
    return F.pmod(portable_hash(key, seed), F.lit(2))
