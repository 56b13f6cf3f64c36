"""Who speaks in a simulation, what a customer wants, how a talk ended, which of two talks is real.

Each is a question to a text oracle or a lookup among real conversations, and always over whole tables: a round of a simulation is one
plan for all talks.
"""

from __future__ import annotations

import zlib
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.hashing import portable_hash
from driftloom.functions.text import match_outcome, search
from driftloom.operators import similar
from driftloom.operators.features import TextOracle
from driftloom.operators.simulate import coin
from driftloom.session import cut_lineage, drop_checkpoint, least_rows

#: Length of the vectors of ``word_counts``.
DIMENSIONS = 128

#: A text with a word, by the same white space as ``str.split``.
_HAS_WORD = "[^\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def detect_outcomes(talks: DataFrame, text: str, outcomes: list[str], oracle: TextOracle, out: str = "outcome") -> DataFrame:
    """``talks`` with the outcome the oracle names for each text, null where it names none of them."""
    said = oracle.column(talks, text, "Which outcome: " + ", ".join(outcomes), "_said")
    return said.withColumn(out, match_outcome(F.col("_said"), outcomes)).drop("_said")


def outcomes_by_neighbours(hits: DataFrame, known: DataFrame, query: str = "query") -> DataFrame:
    """(query, outcome, votes): the outcome most of the similar talks had, ties by the better score, then by name.

    ``hits``: query, key, score of a search; ``known``: key, outcome.
    """
    votes = hits.join(known.where("outcome IS NOT NULL"), "key").groupBy(query, "outcome").agg(F.count("*").alias("votes"), F.max("score").alias("best"))
    place = F.row_number().over(W.partitionBy(query).orderBy(F.desc("votes"), F.desc("best"), "outcome"))
    return votes.withColumn("_r", place).where("_r = 1").select(query, "outcome", "votes")


def extract_intents(messages: DataFrame, conversation: str, at: str, tie: str, role: str, content: str, oracle: TextOracle, kinds: list[str]) -> DataFrame:
    """(conversation, role, opening, intent): who began a conversation, with what words, and what kind of wish the oracle hears in them."""
    first = messages.groupBy(conversation).agg(F.min_by(F.struct(F.col(role).alias("role"), F.col(content).alias("opening")), F.struct(at, tie)).alias("_f")).select(conversation, "_f.role", "_f.opening")
    return oracle.column(first, "opening", "What is wanted: " + ", ".join(kinds), "intent")


def word_counts(texts: pd.Series) -> np.ndarray:
    """Word counts hashed to a fixed number of places, a row per text: an embedding that needs no model."""
    places = [[zlib.crc32(w.encode()) % DIMENSIONS for w in t.lower().split()] for t in texts]
    own = np.repeat(np.arange(len(places)), np.array([len(p) for p in places], "int64")) * DIMENSIONS + np.fromiter(chain.from_iterable(places), "int64")
    return np.bincount(own, minlength=len(places) * DIMENSIONS).reshape(-1, DIMENSIONS).astype("float64")


class Participant(Protocol):
    """Answers the last message of many talks at once: (key, last, said) to (key, reply); no reply is to pass."""

    def reply(self, waiting: DataFrame) -> DataFrame: ...


class OracleParticipant:
    """Asks an oracle what its role says next."""

    def __init__(self, oracle: TextOracle, question: str) -> None:
        self.oracle, self.question = oracle, question

    def reply(self, waiting: DataFrame) -> DataFrame:
        return self.oracle.column(waiting, "last", self.question, "reply").select("key", "reply")


def _with_words(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("id", F.col("id").cast("long")).where(F.col("id").isNotNull() & F.col("last").rlike(_HAS_WORD))


def known_messages(pairs: DataFrame, by: list[str], rows: int | None = None) -> DataFrame:
    """(by, last, first, low): each message once, with the least id and its reply, and those of its ids that have low hashes: about four
    times as many as the sample for the centres, of all ``rows``.
    """
    own = _with_words(pairs)
    share = min(1.0, 4 * similar.SAMPLE_ROWS / max(1, own.count() if rows is None else rows))
    low = F.when(portable_hash(F.col("id")) < int(share * 2**60), F.col("id"))
    return own.groupBy(*by, "last").agg(F.min(F.struct("id", "reply")).alias("first"), F.collect_list(low).alias("low"))


class RetrievalParticipant:
    """Says what was said next to the most similar message in real conversations.

    ``pairs``: id (long), last, reply, of this role's real replies. All of them are searched; a message met often is indexed once, with
    the reply of its least id, as that is the one to win among equals. ``rows``: no less than the pairs there are, where that is known
    without counting them. ``known``: the messages of the pairs, by ``known_messages``, where several roles share the work.
    """

    def __init__(self, pairs: DataFrame, lists: int = 64, probes: int = 16, rows: int | None = None, known: DataFrame | None = None) -> None:
        self.probes = probes
        own = _with_words(pairs).select("id", "last", "reply")
        met = known if known is not None else cut_lineage(known_messages(pairs, [], rows))
        texts = self._sample(met.select(F.explode("low").alias("id"), "last"))
        if len(texts) < similar.SAMPLE_ROWS:  # few of the rows are of this role, or there are no more
            texts = self._sample(least_rows(own.withColumn("_h", portable_hash(F.col("id"))), "_h", "id", similar.SAMPLE_ROWS))
        self.centres = similar.centres_of(word_counts(texts), lists)
        self.indexed = cut_lineage(similar.index(met.select("first.id", "first.reply", "last"), "id", "last", self.centres, word_counts, ["reply"])) if len(self.centres) else None
        if known is None:
            drop_checkpoint(met)

    @classmethod
    def by_role(cls, pairs: DataFrame, role: str, roles: list[str], lists: int = 64, probes: int = 16, rows: int | None = None) -> list["RetrievalParticipant"]:
        """A participant for each role, from pairs of all roles read once."""
        known = cut_lineage(known_messages(pairs.where(F.col(role).isin(roles)), [role], rows))
        made = [cls(pairs.where(F.col(role) == r), lists, probes, rows, known.where(F.col(role) == r)) for r in roles]
        drop_checkpoint(known)
        return made

    @staticmethod
    def _sample(rows: DataFrame) -> pd.Series:
        """Messages of the least hashes of ids."""
        first = rows.orderBy(portable_hash(F.col("id")), "id").limit(similar.SAMPLE_ROWS).collect()
        return pd.Series([r["last"] for r in first], dtype=object)

    def reply(self, waiting: DataFrame) -> DataFrame:
        if self.indexed is None:
            return waiting.select("key", F.lit(None).cast("string").alias("reply"))
        # what is asked by many is looked up once
        asked = cut_lineage(waiting.where("last IS NOT NULL").select("last").distinct().withColumn("_id", F.monotonically_increasing_id()))
        hits = similar.search(self.indexed, asked, "_id", "last", self.centres, 1, self.probes, word_counts)
        said = hits.join(self.indexed.select("key", "reply"), "key").select(F.col("query").alias("_id"), "reply").join(asked, "_id").select("last", "reply")
        return waiting.join(said, "last", "left").select("key", "reply")


class RealParticipant:
    """Says what was really said: ``lines`` has key, at (the place in the talk) and content."""

    def __init__(self, lines: DataFrame) -> None:
        self.lines = lines.select(F.col("key").alias("_k"), F.col("at").alias("_at"), F.col("content").alias("reply"))

    def reply(self, waiting: DataFrame) -> DataFrame:
        return waiting.join(self.lines, (F.col("key") == F.col("_k")) & (F.col("said") == F.col("_at")), "left").select("key", "reply")


def converse(scenarios: DataFrame, key: str, opening: str, agent: Participant, customer: Participant, most: int = 20) -> DataFrame:
    """(key, at, role, content): all talks at once, role by role, each until both pass in turn or it has ``most`` messages.

    A round is one plan over the talks still open; it is cut, so the plan doesn't grow with the rounds.
    """
    open_ones = cut_lineage(scenarios.where(F.col(opening).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(opening).alias("last"), F.lit(1).alias("said"), F.lit(0).alias("passed")))
    said = [open_ones.select("key", F.lit(0).alias("at"), F.lit("customer").alias("role"), F.col("last").alias("content"))]
    answered = F.col("reply").isNotNull()
    for turn in range(2 * most):
        role, who = ("agent", agent) if turn % 2 == 0 else ("customer", customer)
        waiting = open_ones.where((F.col("said") < most) & (F.col("passed") < 2))
        if waiting.limit(1).count() == 0:
            break
        both = waiting.join(who.reply(waiting.select("key", "last", "said")), "key", "left")
        # one text a row is kept: the reply, or what still waits for one
        open_ones = cut_lineage(both.select("key", F.coalesce("reply", "last").alias("last"), (F.col("said") + answered.cast("int")).alias("said"), F.when(answered, 0).otherwise(F.col("passed") + 1).alias("passed")))
        said.append(open_ones.where("passed = 0").select("key", (F.col("said") - 1).alias("at"), F.lit(role).alias("role"), F.col("last").alias("content")))
    out = said[0]
    for part in said[1:]:
        out = out.unionByName(part)
    return out


def tell_real(pairs: DataFrame, key: str, real: str, simulated: str, oracle: TextOracle, seed: int = 42) -> DataFrame:
    """(key, correct): whether the oracle tells the real talk of two, shown in an order tossed for each pair; null where it fails or a talk is empty."""
    first = coin(F.col(key), seed) == 0
    shown = F.concat(F.lit("A:\n"), F.when(first, F.col(real)).otherwise(F.col(simulated)), F.lit("\nB:\n"), F.when(first, F.col(simulated)).otherwise(F.col(real)))
    asked = pairs.select(F.col(key), first.alias("_first"), F.when((F.trim(real) != "") & (F.trim(simulated) != ""), shown).alias("_shown"))
    said = oracle.column(asked, "_shown", "Which one is real: A, B", "_said")
    return said.select(key, F.when(F.col("_said").isin("A", "B"), (F.col("_said") == "A") == F.col("_first")).alias("correct"))


def flatten_talks(messages: DataFrame, outcomes: DataFrame, conversation: str, at: str, tie: str, content: str, kind: str) -> DataFrame:
    """(id, type, num_messages, outcome, first_message): a row per talk for people to look at; no outcome is ``unknown``."""
    rows = messages.groupBy(F.col(conversation).alias("id")).agg(F.count("*").alias("num_messages"), F.min_by(F.col(content), F.struct(at, tie)).alias("_first"))
    known = outcomes.select(F.col("id").alias("_i"), "outcome").dropDuplicates(["_i"])
    joined = rows.join(known, F.col("id") == F.col("_i"), "left")
    return joined.select("id", F.lit(kind).alias("type"), "num_messages", F.coalesce("outcome", F.lit("unknown")).alias("outcome"), F.concat(F.substring("_first", 1, 100), F.lit("...")).alias("first_message"))


def filter_talks(flat: DataFrame, outcome: str | None = None, least: int = 0, most: int | None = None, messages: DataFrame | None = None, conversation: str = "id", content: str = "content", word: str = "", match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Rows of ``flatten_talks`` with an outcome, a number of messages and a word in some message."""
    kept = flat if outcome is None else flat.where(F.col("outcome") == outcome)
    kept = kept.where(F.col("num_messages").between(least, most if most is not None else 2**31))
    if word.strip():
        hits = messages.where(search(F.col(content), word.strip(), match_case, whole_word)).select(F.col(conversation).alias("id")).distinct()
        kept = kept.join(hits, "id", "left_semi")
    return kept


def messages_of(messages: Column, role: str) -> Column:
    """The messages of one role, of an array of them."""
    return F.filter(messages, lambda m: m["role"] == role)


def last_message(messages: Column) -> Column:
    return F.get(messages, F.size(messages) - 1)
