import json

import pytest

from driftloom.operators import nested

NAMES = {"turns": "turn", "attachments": "attachment", "labels": "label", "edits": "edit"}


def as_list(v):
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return []
    if isinstance(v, dict):
        v = [v]
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def by_hand(rows):
    out = set()
    for rid, text in rows:
        try:
            o = json.loads(text)
        except (TypeError, ValueError):
            continue
        if not isinstance(o, dict):
            continue
        inner = o.get("conversation") if isinstance(o.get("conversation"), dict) else {}
        for i, turn in enumerate(as_list(o.get("turns")) + as_list(inner.get("turns"))):
            out.add((rid, "turn", f"{i}"))
            out |= {(rid, "edit", f"{i}.{j}") for j, _ in enumerate(as_list(turn.get("edits")))}
            for j, a in enumerate(as_list(turn.get("attachments"))):
                out.add((rid, "attachment", f"{i}.{j}"))
                out |= {(rid, "label", f"{i}.{j}.{k}") for k, _ in enumerate(as_list(a.get("labels")))}
    return out


CASES = [
    (1, '{"turns": [{"text": "a", "edits": [{"old_text": "b"}]}, null, "--", {"attachments": {"name": "x", "labels": [{"label": "l"}, null, {"label": "m"}]}}]}'),
    (2, '{"conversation": {"turns": {"text": "lone"}}}'),
    (3, json.dumps({"turns": json.dumps([{"text": "in text", "attachments": "[{\"name\": \"n\"}]"}])})),
    (4, '{"turns": [{"text": "cut'),
    (5, '{"turns": [{"text": "x"}]} trailing'),
    (6, None),
    (7, ""),
    (8, "null"),
    (9, "[1, 2]"),
    (10, '{"turns": null, "conversation": {"turns": [{"text": "y"}]}}'),
    (11, '{"turns": []}'),
    (12, '{"turns": [{"attachments": [{"labels": "no json"}, "see mail"]}], "turns": [{"text": "the last one counts"}]}'),
    (13, '<html>502</html>'),
    (14, '{"a": 1}] "x'),
    (15, '{"turns": [{"text": "a"}], "conversation": {"turns": [{"text": "b", "edits": {"old_text": "c"}}]}}'),
]


def run(spark, cases):
    df = spark.createDataFrame(cases, "record_id long, payload string")
    tree = nested.plan_levels(nested.infer_merged_schema(df, "payload"), frozenset(NAMES))
    return {tuple(r) for r in nested.node_paths(df, "record_id", "payload", tree, NAMES).collect()}


def test_cases(spark):
    assert run(spark, CASES) == by_hand(CASES)


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/raw_dialogues.parquet").select("record_id", "payload")
    rows = [tuple(r) for r in df.collect()]
    assert run(spark, rows) == by_hand(rows)


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_flat_tables_link_to_their_parents(spark):
    df = spark.createDataFrame(CASES, "record_id long, payload string")
    tables = {k: v.collect() for k, v in nested.flatten(df, "record_id", "payload", frozenset(NAMES)).items()}
    turns = {(r["record_id"], r["node_path"]) for r in tables["turns"]}
    assert all((r["record_id"], r["parent_path"]) in turns for r in tables["attachments"] + tables["edits"])
    attachments = {(r["record_id"], r["node_path"]) for r in tables["attachments"]}
    assert all((r["record_id"], r["parent_path"]) in attachments for r in tables["labels"])
    assert {r["ordinal"] for r in tables["labels"]} == {0, 1}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, '{"record_id": "own", "turns": [{"node_path": "own", "a": {"b": 1}, "a_b": 2}]}')], "record_id long, payload string")
    tables = nested.flatten(df, "record_id", "payload", frozenset(NAMES))
    assert tables[""].columns == ["record_id", "record_id_"]
    assert len(set(tables["turns"].columns)) == len(tables["turns"].columns)


def test_too_many_paths(spark):
    df = spark.createDataFrame([(1, json.dumps({f"k{i}": i for i in range(50)}))], "record_id long, payload string")
    with pytest.raises(ValueError):
        nested.infer_merged_schema(df, "payload", max_paths=10)
    kinds = [(i, json.dumps({f"k{j}": [1, None, "x", [1], {"a": 1}, "[1]", [{"b": 2}]][i] for j in range(4)})) for i in range(7)]
    found = nested.infer_merged_schema(spark.createDataFrame(kinds, "record_id long, payload string"), "payload", max_paths=20)
    assert all(len(found[f"k{j}",]) >= 6 for j in range(4))
