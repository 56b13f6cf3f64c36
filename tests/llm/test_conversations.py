from driftloom.llm import conversations as cv

FORMS = [("agent", "agent"), ("rep", "agent"), ("customer", "customer"), ("system", "system")]


def tables(spark, rows):
    turns = spark.createDataFrame(rows, "msg_id long, dialogue_id string, sender string, t string, text string").selectExpr("msg_id", "dialogue_id", "sender", "to_timestamp_ntz(t) sent_at", "text", "'x' role", "1 position")
    return turns, spark.createDataFrame(FORMS, "sender_form string, participant string")


ROWS = [
    (1, "ok", " Customer ", "2024-01-01 10:00:00", "hello"), (2, "ok", "REP", "2024-01-01 10:01:00", "hi"), (3, "ok", "rep", "2024-01-01 10:01:00", "hi"), (4, "ok", "customer", "2024-01-01 10:01:00", "bye"),
    (5, "bad", "nobody", "2024-01-01 10:00:00", "x"), (6, "bad", "customer", "2024-01-01 10:00:00", "x"), (7, "untimed", "customer", None, "x"),
    (8, "blank", "customer", "2024-01-01 10:00:00", "  "), (9, "blank", "nobody", None, None), (10, "system", "system", "2024-01-01 10:00:00", "x"),
    (11, "alone", "customer", "2024-01-01 10:00:00", "x"), (12, "same", "customer", "2024-01-01 10:00:00", "x"), (13, "same", "agent", "2024-01-01 10:00:00", "y"),
    (14, "agents", "agent", "2024-01-01 10:00:00", "x"), (15, None, "agent", "2024-01-01 10:00:00", "x"), (16, "early", "agent", "2024-01-01 09:00:00", "x"), (17, "early", "customer", "2024-01-01 10:00:00", "x"),
]


def test_verdicts(spark):
    got = {r["dialogue_id"]: r["defect"] for r in cv.dropped_dialogues(*tables(spark, ROWS)).collect()}
    assert got == {"bad": "broken", "untimed": "broken", "blank": "empty", "system": "empty", "alone": "no_reply", "same": "no_reply", "agents": "no_reply", "early": "no_reply"}


def test_rebuilt(spark):
    got = [(r["position"], r["role"], r["text"], r["msg_id"], r["session_no"]) for r in cv.rebuild(*tables(spark, ROWS)).orderBy("position").collect()]
    assert got == [(1, "customer", "hello", 1, 1), (2, "agent", "hi", 2, 1), (3, "customer", "bye", 4, 1)]


def test_hot_dialogue_against_brute_force(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"d{i % 50}", "agent" if i % 2 else "customer", f"2024-01-{1 + i // 600:02d} {i % 24:02d}:{i % 60:02d}:00", f"m{i}") for i in range(3000)]
    gap = 3 * 3600 * 1_000_000
    turns, forms = tables(spark, rows)
    dropped = {r["dialogue_id"] for r in cv.dropped_dialogues(turns, forms).collect()}
    got = {r["msg_id"]: (r["position"], r["session_no"]) for r in cv.rebuild(turns, forms, gap).collect()}
    want, by = {}, {}
    for m in sorted(rows, key=lambda r: (r[3], r[0])):
        by.setdefault(m[1], []).append(m)
    from datetime import datetime

    for d, ms in by.items():
        if d in dropped:
            continue
        session, last = 1, None
        for i, m in enumerate(ms):
            t = datetime.fromisoformat(m[3])
            session += last is not None and (t - last).total_seconds() * 1e6 > gap
            last = t
            want[m[0]] = (i + 1, session)
    assert got == want


def test_threshold_between_clusters():
    pauses, silences = [(100 + i, 1000 - 10 * abs(i - 5)) for i in range(10)], [(160 + i, 5) for i in range(10)]
    cut = cv.cut_between_clusters(pauses + silences)
    assert 2 ** (110 / cv.BINS_PER_OCTAVE) <= cut <= 2 ** (160 / cv.BINS_PER_OCTAVE)
    assert cv.cut_between_clusters([]) == 2**62 and cv.cut_between_clusters([(7, 3)]) == 2**62


def test_empty(spark):
    assert cv.dropped_dialogues(*tables(spark, [])).count() == 0 and cv.rebuild(*tables(spark, [])).count() == 0


def test_sessions_of_unplaced_messages(spark):
    got = {(r["dialogue_id"], r["session_no"]): r for r in cv.sessions(*tables(spark, ROWS)).collect()}
    assert got["blank", 0]["messages"] == 2 and not got["blank", 0]["unusable"] and got["untimed", 0]["unusable"]
    assert got["ok", 1]["messages"] == 3 and got["ok", 1]["replied"] and not got["early", 1]["replied"]


def test_sessions_without_reply_are_told_and_can_be_dropped(spark):
    rows = [
        (1, "d", "customer", "2024-01-01 10:00:00", "a"), (2, "d", "agent", "2024-01-01 10:01:00", "b"), (3, "d", "customer", "2024-01-05 10:00:00", "alone"), (4, "d", "customer", "2024-01-09 10:00:00", "c"), (5, "d", "agent", "2024-01-09 10:02:00", "d"),
        (6, "late", "customer", "2024-01-01 10:00:00", "q"), (7, "late", "agent", "2024-01-03 10:00:00", "r"), (8, "never", "agent", "2024-01-01 10:00:00", "r"), (9, "never", "customer", "2024-01-03 10:00:00", "q"),
    ]
    turns, forms = tables(spark, rows)
    hour = 3600 * 1_000_000
    got = {r["msg_id"]: (r["session_no"], r["session_replied"]) for r in cv.rebuild(turns, forms, hour).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (2, False), 4: (3, True), 5: (3, True), 6: (1, False), 7: (2, False)}
    assert {r["msg_id"] for r in cv.rebuild(turns, forms, hour, replied_only=True).collect()} == {1, 2, 4, 5}
    assert {(r["dialogue_id"], r["defect"]) for r in cv.dropped_dialogues(turns, forms, hour).collect()} == {("never", "no_reply")}


def test_messages_without_an_id(spark):
    rows = [(1, "d", "customer", "2024-01-01 10:00:00", "a"), (None, "d", "agent", "2024-01-01 10:01:00", "b"), (None, "d", "agent", "2024-01-01 10:01:00", "b"), (4, "d", "customer", "2024-01-01 10:02:00", "c")]
    got = [(r["position"], r["text"], r["msg_id"]) for r in cv.rebuild(*tables(spark, rows)).orderBy("position").collect()]
    assert got == [(1, "a", 1), (2, "b", None), (3, "c", 4)]
