"""A whole simulation: scenarios from real conversations, simulated talks, detected outcomes, comparison, JSON."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import participants, sampling, simulate
from driftloom.operators.features import TextOracle, keyword_oracle
from driftloom.progress import stage
from driftloom.session import cut_lineage

Replies = Callable[[str, list[tuple[str, str]]], str | None]


@dataclass(frozen=True)
class Results:
    """``scenarios``: conversation id, scenario_id, intent, outcome; ``talks``: scenario_id, at, role, content, and ``outcomes`` of them."""

    scenarios: DataFrame
    talks: DataFrame
    outcomes: DataFrame

    def comparison(self) -> DataFrame:
        return simulate.compare_outcomes(self.scenarios, self.outcomes, "outcome")

    def lengths(self) -> DataFrame:
        return simulate.message_statistics(self.talks, "scenario_id")

    def analysis(self, real: DataFrame, oracle: TextOracle, most_pairs: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
        """Outcomes side by side, shares of each, message counts, and how well an oracle tells real talks from simulated ones.

        ``real``: conversation_id, talk (text). Each simulated talk meets the real one it comes from.
        """
        line = F.struct("at", F.concat(F.initcap("role"), F.lit(": "), F.col("content")).alias("line"))  # a talk has at most most_messages lines
        simulated = self.talks.groupBy("scenario_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("simulated"))
        pairs = self.scenarios.select("scenario_id", "conversation_id").join(simulated, "scenario_id").join(real.select("conversation_id", F.col("talk").alias("real")), "conversation_id")
        told = participants.tell_real(sampling.uniform(pairs, "scenario_id", most_pairs, seed), "scenario_id", "real", "simulated", oracle, seed)
        return {
            "comparison": self.comparison(), "real_outcomes": simulate.outcome_distribution(self.scenarios, "outcome"), "simulated_outcomes": simulate.outcome_distribution(self.outcomes, "outcome"),
            "lengths": self.lengths(), "adversarial": simulate.accuracy(told, F.col("correct")),
        }

    def save(self, path: str) -> None:
        for name in ("scenarios", "talks", "outcomes"):
            getattr(self, name).write.mode("overwrite").json(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Results:
    schemas = {"scenarios": "conversation_id string, scenario_id string, intent string, outcome string", "talks": "scenario_id string, at int, role string, content string", "outcomes": "scenario_id string, outcome string"}
    return Results(**{n: spark.read.schema(s).json(f"{path}/{n}") for n, s in schemas.items()})


@dataclass(frozen=True)
class Session:
    """Built step by step: ``Session(outcomes).with_replies(…).with_oracle(…).run(openings)``."""

    outcomes: tuple[str, ...]
    replies: Replies | None = None
    oracle: TextOracle | None = None
    most_messages: int = 20
    agent: participants.Participant | None = None
    customer: participants.Participant | None = None

    def with_replies(self, replies: Replies) -> "Session":
        return replace(self, replies=replies)

    def with_oracle(self, oracle: TextOracle) -> "Session":
        return replace(self, oracle=oracle)

    def with_participants(self, agent: participants.Participant, customer: participants.Participant) -> "Session":
        return replace(self, agent=agent, customer=customer)

    def with_most_messages(self, n: int) -> "Session":
        return replace(self, most_messages=n)

    def run(self, openings: DataFrame) -> Results:
        """``openings``: conversation_id, intent (the customer's first words), outcome. Those without intent are skipped."""
        if self.replies is None and (self.agent is None or self.customer is None):
            raise ValueError("no replies and no participants")
        kept = openings.where("conversation_id IS NOT NULL")
        scenarios = simulate.dense_scenarios(kept, "conversation_id", F.col("intent").isNotNull() & (F.trim("intent") != "")).select("conversation_id", "scenario_id", "intent", "outcome")
        if self.agent is not None:
            # all talks at once, by participants that look things up
            talks = participants.converse(scenarios, "scenario_id", "intent", self.agent, self.customer, self.most_messages)
        else:
            talks = simulate.simulate_turns(scenarios, "scenario_id", "intent", self.replies, self.most_messages)
        with stage("simulate"):
            talks = cut_lineage(talks.withColumnRenamed("key", "scenario_id"))
        line = F.struct("at", F.concat(F.initcap("role"), F.lit(": "), F.col("content")).alias("line"))  # a talk has at most most_messages lines
        texts = talks.groupBy("scenario_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("talk"))
        ended = participants.detect_outcomes(texts, "talk", list(self.outcomes), self.oracle or keyword_oracle())
        return Results(scenarios, talks, ended.select("scenario_id", "outcome"))
