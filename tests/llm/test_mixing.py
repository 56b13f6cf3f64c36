from collections import Counter

from driftloom.llm import mixing


def build(spark, rows, targets):
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    plan = mixing.source_plan(sized, spark.createDataFrame(targets, "source string, target_share double, max_repeats int, budget_frac double"))
    return sized, plan


ROWS = [(i, "big" if i % 3 else ("mid" if i % 2 else None), 50 + i % 100) for i in range(6000)] + [(10_000 + i, "small", 100) for i in range(20)] + [(20_000, "big", 0)]
TARGETS = [("big", 0.5, 1, 0.4), ("mid", 0.3, 2, 0.4), ("small", 0.1, 3, 0.4), ("absent", 0.1, 2, 0.4)]


def test_shares_and_repeats(spark):
    sized, plan = build(spark, ROWS, TARGETS)
    mixed = mixing.mix(sized, plan, block_tokens=500)
    rows = mixed.collect()
    assert max(Counter((r["source"], r["doc_id"]) for r in rows if r["source"] == "big").values()) == 1
    assert set(Counter(r["doc_id"] for r in rows if r["source"] == "small").values()) == {3}
    assert all(r["tokens"] > 0 for r in rows)
    budget = 0.4 * sum(r[2] for r in ROWS)
    used = Counter()
    for r in rows:
        used[r["source"]] += r["tokens"]
    assert 0 <= used["big"] - 0.5 * budget < 150 and used["small"] == 6000
    report = {r["source"]: r for r in mixing.mix_report(mixed, plan).collect()}
    assert {s for s, r in report.items() if r["short"]} == {"small", "absent"}
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-5


def test_every_stretch_has_the_shares(spark):
    sized, plan = build(spark, ROWS, TARGETS[:2])
    slots = [r["source"] for r in mixing.schedule(plan, 500).where("nth < 100").orderBy("slot").collect()]
    for at in range(0, 60, 20):
        assert 9 <= Counter(slots[at : at + 20])["big"] <= 16


def test_passes_do_not_overlap_before_all_documents_were_used(spark):
    sized, plan = build(spark, [(i, "s", 10) for i in range(10)], [("s", 1.0, 3, 2.5)])
    counts = Counter(r["doc_id"] for r in mixing.mix(sized, plan, block_tokens=20).collect())
    assert len(counts) == 10 and set(counts.values()) == {2, 3}


def test_empty(spark):
    sized, plan = build(spark, [], TARGETS)
    assert mixing.mix(sized, plan).count() == 0
    assert not plan.where("short").count()
