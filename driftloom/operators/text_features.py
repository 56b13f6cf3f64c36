"""Features that a text oracle answers about each conversation, from question to typed column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.text import fenced_json, token_estimate
from driftloom.operators import sampling
from driftloom.operators.features import Feature, TextOracle, answer_typed
from driftloom.operators.generate import Generated, empty_shares, infer_kinds, top_categories
from driftloom.operators.joins import first_of_equal, only_with
from driftloom.operators.recommend import within_budget
from driftloom.session import cut_lineage


@dataclass(frozen=True)
class TextFeature:
    name: str
    question: str
    kind: str = "str"
    categories: tuple[str, ...] = ()

    def typed(self, answer: Column) -> Column:
        return answer_typed(answer, self.kind, self.categories)

    def as_feature(self, text: str) -> Feature:
        """The same as a feature of a row; free text can't be one."""
        return Feature(self.name, self.kind, question=self.question, params=(text,), categories=self.categories)


def answer(df: DataFrame, text: str, features: Sequence[TextFeature], oracle: TextOracle) -> DataFrame:
    """``df`` with a typed column per feature. A failed answer is null in its own column only."""
    for f in features:
        df = oracle.column(df, text, f.question, f"_answer_{f.name}")
        df = df.withColumn(f.name, f.typed(F.col(f"_answer_{f.name}"))).drop(f"_answer_{f.name}")
    return df


def propose_questions(df: DataFrame, key: str, text: str, goal_text: str, oracle: TextOracle, examples: int = 20, budget: int = 20_000, most: int = 30) -> dict[str, str]:
    """Questions an oracle proposes after seeing as many texts as fit, by name; equal ones but for case and blanks are asked once.

    The answer must hold one block of JSON: a list of texts.
    """
    shown = sampling.uniform(df.where(F.col(text).isNotNull()).select(key, text), key, examples)
    fit = within_budget(shown.withColumn("_tokens", token_estimate(F.col(text))), key, "_tokens", budget)
    request = goal_text + "\n\n" + "\n---\n".join(r[text] for r in fit.orderBy(key).collect())  # at most ``examples``
    asked = oracle.column(df.sparkSession.createDataFrame([(request,)], "request string"), "request", "Propose questions", "said")
    read = asked.select(F.posexplode(F.from_json(fenced_json(F.col("said")), "array<string>")).alias("place", "question"))
    kept = only_with(read, "place", first_of_equal(read, "question", "place"), "place").orderBy("place").limit(most).collect()
    return {f"question_{r['place']}": r["question"].strip() for r in kept}


class OracleQuestions:
    """A generator of features that an oracle answers about a text column: given questions, or ones it proposes itself, tried on a sample of
    the search rows.
    """

    def __init__(self, oracle: TextOracle, text: str, questions: dict[str, str] | None = None, goal_text: str = "", rows: int = 200) -> None:
        self.oracle, self.text, self.questions, self.goal, self.rows = oracle, text, questions, goal_text, rows

    def generate(self, search: DataFrame, target: str, key: str, tables: dict[str, DataFrame]) -> Iterator[Generated]:
        questions = self.questions or propose_questions(search, key, self.text, self.goal, self.oracle)
        stratified = None if isinstance(search.schema[target].dataType, (T.FloatType, T.DoubleType)) else target
        for f in develop(search, key, self.text, questions, self.oracle, self.rows, target=stratified):
            if f.kind != "category" or f.categories:
                yield Generated(f.as_feature(self.text), f.kind in ("bool", "category"))


def regroup(df: DataFrame, column: str, most: int = 9) -> tuple[str, ...]:
    """Categories for free answers: the most frequent ones; the rest will be ``_other_``."""
    return tuple(r["value"] for r in top_categories(df, column, most).collect())


def develop(df: DataFrame, key: str, text: str, questions: dict[str, str], oracle: TextOracle, rows: int = 200, most_empty: float = 0.5, target: str | None = None, most_categories: int = 9) -> list[TextFeature]:
    """Questions tried on a sample of texts: those hardly answered are dropped, the others get the kind of their answers."""
    own = df.where(F.col(text).isNotNull())
    sample = sampling.by_class(own, key, target, rows, balanced=True) if target else sampling.uniform(own, key, rows)
    raw = answer(sample.select(key, text), text, [TextFeature(n, q) for n, q in questions.items()], oracle)
    raw = cut_lineage(raw)
    empty = {r["column"]: r["empty_share"] for r in empty_shares(raw, list(questions)).collect()}
    kept = [n for n in questions if empty[n] is not None and empty[n] <= most_empty]
    kinds = {r["column"]: r for r in infer_kinds(raw, kept, most=most_categories).collect()} if kept else {}
    out = []
    for n in kept:
        f = TextFeature(n, questions[n], kinds[n]["kind"], tuple(kinds[n]["categories"] or ()))
        out.append(replace(f, kind="category", categories=regroup(raw, n, most_categories)) if f.kind == "str" else f)
    return out
