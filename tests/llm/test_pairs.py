from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm import pairs


def slow_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=70), st.lists(st.sampled_from("abcd"), max_size=70))
def test_common_subsequence(a, b):
    assert pairs.common_subsequence(a, b) == slow_common(a, b)


PROMPT = "Could you tell me when the problem with the router started?"
FILLER = [(100 + i, PROMPT, f"It started {i} days ago. You will find it on the invoice. We can look at it again in May.", True) for i in range(30)]
CASES = [
    (1, PROMPT, None, True, "empty"), (2, PROMPT, "  \t", True, "empty"), (3, PROMPT, "N/A", True, "empty"), (4, PROMPT, "[no response]", True, "empty"), (5, PROMPT, "--", True, "empty"),
    (6, PROMPT, "  could  you tell me when the problem with the router started", True, "copy"), (7, PROMPT, f"{PROMPT} {PROMPT}", True, "copy"), (8, PROMPT, f"Q: {PROMPT}", True, "copy"),
    (9, PROMPT, f'You asked: "{PROMPT}" It was on Monday, after the storm, and it got worse in the evening.', True, None),
    (10, PROMPT, "As a language model I am not able to take part in this conversation.", True, "refusal"), (11, PROMPT, "Hello! I won't continue this dialogue.", True, "refusal"),
    (12, PROMPT, "I am not able to waive the fee, although a pause is possible.", True, None), (13, PROMPT, "I can't talk at work.", True, None),
    (14, PROMPT, "Das hat vor vier Tagen nach dem Sturm angefangen.", True, "other_language"), (15, PROMPT, "Bonjour, it started on Monday after the storm.", True, None),
    (16, PROMPT, "It started 4 days ago. You will find it on the inv", True, "truncated"), (17, PROMPT, "It started 4 days ago. You will find it on the", True, "truncated"),
    (18, PROMPT, None, False, None), (19, PROMPT, None, None, None), (20, None, "It started 4 days ago.", True, None), (21, None, None, True, "empty"),
    (22, PROMPT, "It started 4 days ago. You will find it on the inv", True, "truncated"),
]


def test_cases(spark):
    df = spark.createDataFrame([c[:4] for c in CASES] + FILLER, "pair_id long, prompt string, response string, should_respond boolean")
    got = {r["pair_id"]: r["defect"] for r in pairs.broken_pairs(df, "pair_id", "prompt", "response", "should_respond").collect()}
    assert got == {c[0]: c[4] for c in CASES if c[4]}


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "pair_id long, prompt string, response string, should_respond boolean, defect string, _id int, text string")
    assert pairs.broken_pairs(df, "pair_id", "prompt", "response", "should_respond").count() == 0
    one = spark.createDataFrame([(1, "a", None, True, "x", 5, "t")], df.schema)
    assert [tuple(r) for r in pairs.broken_pairs(one, "pair_id", "prompt", "response", "should_respond").collect()] == [(1, "empty")]


def test_very_long_texts(spark):
    long = "word and other words of the text " * 20_000
    df = spark.createDataFrame([(1, long, long + "x", True), (2, "short?", long, True)], "pair_id long, prompt string, response string, should_respond boolean")
    got = {r["pair_id"]: r["defect"] for r in pairs.broken_pairs(df, "pair_id", "prompt", "response", "should_respond").collect()}
    assert got[1] == "copy"


def slow_refusal(response, texts):
    import re

    templates = [pairs._tokens(t.replace("*", " ")) for t in texts]
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", response):
        words = pairs._tokens(sentence)
        for t in templates:
            need = max(pairs.REFUSAL_LIKENESS * len(t), min(len(t), 4))
            if any(pairs.common_subsequence(t, words[i : i + len(t) + 2]) >= need for i in range(max(1, len(words) - len(t) + 1))):
                return True
    return False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("i can not help with that as an ai model write this message please answer the bill . we".split()), max_size=25))
def test_the_index_of_templates_loses_none(words):
    text = " ".join(words)
    assert pairs.is_refusal(text, pairs.Templates(pairs.REFUSALS)) == slow_refusal(text, pairs.REFUSALS)
