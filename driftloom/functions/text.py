"""Text of conversations and tables for people and for language models, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def truncated(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def preview(text: Column, limit: int = 100) -> Column:
    return F.substring(text, 1, limit)


def as_number(text: Column, kind: str) -> Column:
    """``bigint`` or ``double`` of a text that is nothing but that, else null; surrounding space isn't part of a number."""
    return F.when(text == F.trim(text), text.try_cast(kind))


def dated_lines(messages: Column) -> Column:
    """Lines of messages (array of at, role, content in order): a ``Date:`` line wherever the day changes."""
    day = lambda m: F.date_format(m["at"], "yyyy-MM-dd")
    line = lambda m: F.concat(F.lit("["), F.date_format(m["at"], "HH:mm:ss"), F.lit("] ["), m["role"], F.lit("] "), m["content"])
    lines = F.transform(
        messages,
        lambda m, i: F.when((i > 0) & (day(m) == day(F.element_at(messages, i))), line(m)).otherwise(F.concat(F.lit("Date: "), day(m), F.lit("\n"), line(m))),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def role_lines(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n")


def highlighted_lines(messages: Column, current: Column) -> Column:
    """Lines with the message at index ``current`` marked as the last one and the following one as the response to it."""
    line = lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])
    marked = lambda m, a, b: F.concat(F.lit(f"**{a} "), F.initcap(m["role"]), F.lit(f" {b}**: "), m["content"])
    return F.array_join(F.transform(messages, lambda m, i: F.when(i == current, marked(m, "Last", "message")).when(i == current + 1, marked(m, "Current", "response")).otherwise(line(m))), "\n")


def search(text: Column, word: str, match_case: bool = False, whole_word: bool = False) -> Column:
    """Whether a text holds a word, matched as plain text."""
    if whole_word:
        return text.rlike(("" if match_case else "(?i)") + r"(?U)\b\Q" + word.replace("\\E", "") + r"\E\b")
    return F.contains(text if match_case else F.lower(text), F.lit(word if match_case else word.lower()))


def fenced_json(text: Column) -> Column:
    """The content of the only fenced JSON block of a text; null if there is none or more than one."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(.*?)\s*```"), F.lit(1))
    return F.when(F.size(blocks) == 1, blocks[0])


def json_field(text: Column, name: str) -> Column:
    """A top-level field as text; null where the text isn't JSON or has no such field."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{name}", "string")


def match_outcome(answer: Column, outcomes: list[str]) -> Column:
    """The outcome an answer names: the one equal to it, else the first in the list it contains, case aside."""
    plain = F.lower(F.trim(answer))
    equal = F.coalesce(*(F.when(plain == o.lower(), F.lit(o)) for o in outcomes))
    inside = F.coalesce(*(F.when(F.contains(plain, F.lit(o.lower())), F.lit(o)) for o in outcomes))
    return F.coalesce(equal, inside)


def markdown_schema(df: DataFrame, title: str, sample_rows: int = 5, limit: int = 100) -> str:
    """A table's schema and first rows as text, long strings shortened."""
    lines = [f"## {title}", "", "| column | type |", "| --- | --- |", *(f"| {f.name} | {f.dataType.simpleString()} |" for f in df.schema.fields), ""]
    short = df.select(*(truncated(F.col(f"`{f.name}`").cast("string"), limit).alias(f.name) for f in df.schema.fields)).limit(sample_rows)
    rows = [",".join('"' + str(v).replace('"', '""') + '"' if v is not None and any(c in str(v) for c in ',"\n') else "" if v is None else str(v) for v in r) for r in short.collect()]
    return "\n".join([*lines, ",".join(df.columns), *rows, ""])


def unique_names(names: list[str], taken: set[str] = frozenset()) -> list[str]:
    """Each name with as many ``_`` as keep it apart from the earlier ones and from ``taken``."""
    out, used = list[str](), set(taken)
    for n in names:
        while n in used:
            n += "_"
        out.append(n)
        used.add(n)
    return out


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)
