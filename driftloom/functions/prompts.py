"""Texts put to a language model: the goal, the tables, the form of an answer. Driver strings only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftloom.functions.text import markdown_schema

ANSWER_FORMS = {
    "bool": "Answer with true or false.",
    "int": "Answer with one whole number.",
    "float": "Answer with one number.",
    "category": "Answer with exactly one of: {options}.",
    "str": "Answer in a few words.",
}


def goal(target: str, kind: str, desired: object, classes: tuple = ()) -> str:
    """What the analysis is for. The wanted outcome must be named: a class, or up or down."""
    if desired is None:
        raise ValueError("the wanted outcome is missing")
    if kind == "classification":
        if desired not in classes:
            raise ValueError(f"{desired!r} is none of the classes")
        return f"Find what makes {target} more likely to be {desired} (classes: {', '.join(map(str, classes))})."
    if desired not in ("up", "down"):
        raise ValueError("a regression wants up or down")
    return f"Find what moves {target} {desired}."


def answer_form(kind: str, options: tuple[str, ...] = ()) -> str:
    return ANSWER_FORMS[kind].format(options=", ".join(options))


def tables(named: dict[str, DataFrame], rows: int = 5) -> str:
    """Schemas and first rows of several tables."""
    return "\n".join(markdown_schema(df, name, rows) for name, df in named.items())


def question_about(text: str, question: str, kind: str, options: tuple[str, ...] = ()) -> str:
    return f"{question}\n{answer_form(kind, options)}\n\n{text}"


def recommendation_request(goal_text: str, feature_lines: str, examples: list[str]) -> str:
    """Ranked features and numbered example conversations, to be referred to by their numbers."""
    shown = "\n".join(f"--- Conversation {i + 1} ---\n{t}" for i, t in enumerate(examples))
    return f"{goal_text}\n\nFeatures by explained variance:\n{feature_lines}\n\n{shown}"
