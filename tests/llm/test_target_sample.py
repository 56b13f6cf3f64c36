import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftloom.llm import target_sample as ts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 30), st.integers(0, 200)), min_size=1, max_size=8), st.integers(0, 600))
def test_allotment(parts, size):
    shares, floors, caps = ([p[i] for p in parts] for i in range(3))
    q = ts.allot(size, shares, floors, caps)
    low = [min(f, c) for f, c in zip(floors, caps)]
    assert all(a <= x <= c for a, x, c in zip(low, q, caps))
    assert sum(q) == max(min(size, sum(caps)), sum(low))


def test_allotment_without_bounds_is_largest_remainder():
    assert ts.allot(10, [0.5, 0.3, 0.2], [0, 0, 0], [99, 99, 99]) == [5, 3, 2]
    assert ts.allot(7, [0.5, 0.25, 0.25], [0, 0, 0], [99, 99, 99]) == [3, 2, 2]
    assert ts.allot(100, [0.98, 0.02], [0, 10], [200, 50]) == [90, 10]
    assert ts.allot(100, [0.5, 0.5], [0, 0], [20, 500]) == [20, 80]


def test_drawn_rows_are_those_of_the_least_keys(spark):
    rows = [(str(i), "hot" if i % 3 else "cold") for i in range(20_000)] + [("20001", "none")]
    df = spark.createDataFrame(rows, "id string, category string")
    targets = spark.createDataFrame([("f", "hot", 0.5, 5, 0.1), ("f", " COLD", 0.5, 5, 0.1), ("f", "absent", 0.0, 3, 0.1)], "target_field string, category string, target_share double, min_rows int, sample_frac double")
    report = ts.quota_report(df, targets)
    got = {(r["id"], r["category"]) for r in ts.draw(df, report).collect()}
    by_hand = set()
    keys = {(i, c): int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:15], 16) for i, c in rows}
    for name, quota in (("hot", 1000), ("cold", 1000)):
        order = sorted((k, i) for (i, c), k in keys.items() if c == name)
        by_hand |= {(i, name) for _, i in order[:quota]}
    assert got == by_hand
    told = {r["category"]: (r["available"], r["quota"], r["missed"]) for r in report.collect()}
    assert told["absent"] == (0, 0, True) and told["hot"][2] is False and told[" COLD"][1] == 1000


def test_eligible(spark):
    df = spark.createDataFrame([("a", " Sold "), ("a", "sold"), ("b", None), (None, "sold"), ("c", "LOST")], "k string, o string")
    assert {tuple(r) for r in ts.eligible(df, "k", "o").collect()} == {("a", "sold"), ("c", "lost")}


def test_empty(spark):
    rows = spark.createDataFrame([], "id string, category string")
    targets = spark.createDataFrame([("f", "x", 1.0, 1, 0.5)], "target_field string, category string, target_share double, min_rows int, sample_frac double")
    report = ts.quota_report(rows, targets)
    assert report.first()["missed"] and ts.draw(rows, report).count() == 0
