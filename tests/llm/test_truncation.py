import numpy as np

from driftloom.llm import truncation

SENTENCES = ["The router was shipped on {d}.", "You will find the amount on the invoice.", "We moved the start date to {d}.", "The customer called twice about the fee.", "A technician will look at the line next week.", "Somebody from the back office may call about it.", "Nothing changes for the other contracts."]
DAYS = ["Monday", "Tuesday", "Friday"]


def text(rng, n):
    return " ".join(SENTENCES[rng.integers(len(SENTENCES))].format(d=DAYS[rng.integers(3)]) for _ in range(n))


def corpus(seed=5, n=600):
    rng = np.random.default_rng(seed)
    rows, cut = [], set()
    for i in range(n):
        t, source = text(rng, int(rng.integers(2, 9))), "notes" if i % 2 else "mail"
        if source == "notes" and len(t) > 200:
            t = t[:200]
            if not t.rstrip().endswith("."):
                cut.add(i)
        elif i % 29 == 0:
            t = t[: int(rng.integers(20, len(t) - 3))]
            if not t.rstrip().endswith("."):
                cut.add(i)
        rows.append((i, t, source))
    return rows, cut


def test_cuts_are_found(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows + [(9000, None, "mail"), (9001, "   ", None)], "doc_id long, text string, source string")
    found = {r["doc_id"] for r in truncation.cut_texts(df, "doc_id", "text", "source").collect()}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.02 * len(rows)
    assert 200 in {r["length"] for r in truncation.limit_posteriors(df, "text", "source").where("source = 'notes'").collect()}


def test_forms_of_endings(spark):
    rows, _ = corpus()
    whole = "You will find the amount on the invoice. A technician will look at the line next week."
    ends = {10_001: (whole + " [...]", True), 10_002: (whole + "\nCustomer:", True), 10_003: (whole + " Nothing changes for the &am", True), 10_004: (whole + " 👍", False), 10_005: (whole + "\n(closed)", False), 10_006: (whole + " (truncated)", True), 10_007: (whole + " The customer called <br", True), 10_008: (whole, False)}
    df = spark.createDataFrame(rows + [(k, v[0], "mail") for k, v in ends.items()], "doc_id long, text string, source string")
    found = {r["doc_id"] for r in truncation.cut_texts(df, "doc_id", "text", "source").collect()}
    assert {k for k in ends if k in found} == {k for k, v in ends.items() if v[1]}


def test_shared_closings_are_no_cuts(spark):
    rows, _ = corpus()
    rows = [(i, t + "\nKind regards\nService desk" if i % 5 == 0 and t.endswith(".") else t, s) for i, t, s in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"] for r in truncation.cut_texts(df, "doc_id", "text", "source").collect()}
    assert not {i for i, t, _ in rows if t.endswith("desk")} & found


def test_censored_fit():
    rng = np.random.default_rng(2)
    sizes = np.minimum(np.exp(rng.normal(6, 0.7, 4000)).astype(int), 500)
    lengths, counts = np.unique(sizes, return_counts=True)
    assert [v for v, _ in truncation.censored_fit(lengths, counts)] == [500]
    assert truncation.censored_fit(np.array([10]), np.array([3])) == []


def test_report_and_empty_table(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows + [(9000, None, None)], "doc_id long, text string, source string")
    report = {r["source"]: r for r in truncation.cut_report(df, "doc_id", "text", "source").collect()}
    assert sum(r["documents"] for r in report.values()) == len(rows) + 1 and report[None]["cut"] == 0
    empty = df.limit(0)
    assert truncation.cut_texts(empty, "doc_id", "text", "source").count() == 0 and truncation.cut_report(empty, "doc_id", "text", "source").count() == 0


def test_limits_teach_what_endings_weigh():
    # degree 3 stands at limits only, degree -3 never; whole texts count as whole wherever they stand
    counts = [(3, 0.95, False, 90), (3, None, False, 5), (-3, 0.95, False, 5), (-3, None, False, 900), (-6, 0.95, True, 60), (-6, None, True, 3000)]
    weights, rate = truncation.ending_weights(counts)
    assert weights[3] > 2 and weights[-3] < -1 and weights[-6] < weights[3] and 0 < rate < 0.05
    assert all(weights[d] <= weights[d + 1] for d in range(-8, 13)) and weights[13] >= truncation.SURE_WEIGHT
    # without any limit only sure marks count
    weights, _ = truncation.ending_weights([(3, None, False, 90), (12, None, False, 4)])
    assert weights[6] < 0 < weights[7]


def test_json_is_open_however_long_ago_it_began():
    from driftloom.llm.endings import _inside_json, _tail_tokens

    long = 'Read this: {"text": "' + "word " * 500
    assert _inside_json(long) and not _inside_json(long + '"}') and not _inside_json("no json") and _inside_json('{"a": {"b": 1}, "c": [1, 2')
    assert _tail_tokens("x " * 400 + "I paid 12.50 Euro", 3) == ["paid", "0", "euro"] and _tail_tokens("", 3) == ["\n"] * 3


def test_extra_and_clashing_columns(spark):
    rows, cut = corpus(n=200)
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = plain.selectExpr("doc_id", "text AS body", "source AS origin", "1 AS length", "'x' AS text", "2.0D AS posterior", "'y' AS source", "3 AS _id", "4 AS same", "5 AS cut_evidence", "6 AS _key")
    found = lambda d, t, s: {r["doc_id"] for r in truncation.cut_texts(d, "doc_id", t, s).collect()}
    assert found(odd, "body", "origin") == found(plain, "text", "source")
    twice = plain.unionByName(plain.withColumn("doc_id", plain["doc_id"] + 10_000))
    again = found(twice, "text", "source")
    assert {i + 10_000 for i in again if i < 10_000} == {i for i in again if i >= 10_000}
