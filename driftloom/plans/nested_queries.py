"""Queries of the nested-record operator (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.operators import nested
from driftloom.plans.registry import query
from driftloom.session import table

LISTS = {"turns": "turn", "attachments": "attachment", "labels": "label", "edits": "edit"}


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, nested.Level]:
    raw = table(spark, d, "raw_dialogues").select("record_id", "payload")
    return raw, nested.plan_levels(nested.infer_merged_schema(raw, "payload"), frozenset(LISTS))


def _objects(x: str) -> str:
    """DuckDB: the objects of a list given as array, lone object or JSON text."""
    y = f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END)"
    whole = f"CASE json_type({y}) WHEN 'ARRAY' THEN CAST(json_extract({y}, '$[*]') AS JSON[]) WHEN 'OBJECT' THEN [{y}] ELSE CAST([] AS JSON[]) END"
    return f"list_filter({whole}, lambda e: json_type(e) = 'OBJECT')"


def _level(source: str, field: str, path: str) -> str:
    lists = _objects(f"json_extract(node, '$.{field}')")
    return f"SELECT record_id, {path} AS parent, unnest(range(len(l))) AS n, unnest(l) AS node FROM (SELECT *, {lists} AS l FROM {source})"


_NODES = f"""
WITH root AS (SELECT record_id, CAST(payload AS JSON) AS node FROM raw_dialogues WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
pairs AS (SELECT record_id, {_objects("json_extract(node, '$.turns')")} AS a, {_objects("json_extract(node, '$.conversation.turns')")} AS b FROM root),
turns AS (SELECT record_id, CAST(NULL AS VARCHAR) AS parent, n, CAST(n AS VARCHAR) AS path, node FROM (SELECT record_id, unnest(range(len(l))) AS n, unnest(l) AS node FROM (SELECT record_id, list_concat(a, b) AS l FROM pairs))),
attachments AS (SELECT *, parent || '.' || n AS path FROM ({_level("turns", "attachments", "path")})),
labels AS (SELECT *, parent || '.' || n AS path FROM ({_level("attachments", "labels", "path")})),
edits AS (SELECT *, parent || '.' || n AS path FROM ({_level("turns", "edits", "path")}))"""


def _flat_sql(name: str, fields: list[str]) -> str:
    values = ", ".join(f"json_extract_string(node, '$.{f}') AS {f}" for f in fields)
    return f"{_NODES} SELECT record_id, path AS node_path, parent AS parent_path, CAST(n AS INT) AS ordinal, {values} FROM {name}"


_RECORD_FIELDS = ["conversation.lang", "dialogue_id", "meta.client.os", "meta.client.v", "meta.turns", "outcome", "outcome.detail.by", "outcome.detail.score", "outcome.name", "source"]
_FLAT_SQL = {
    "": _NODES + " SELECT record_id, " + ", ".join(f"CASE WHEN json_type(json_extract(node, '$.{f}')) <> 'OBJECT' THEN json_extract_string(node, '$.{f}') END AS {f.replace('.', '_')}" for f in _RECORD_FIELDS) + " FROM root",
    "turns": _flat_sql("turns", ["sender", "text", "timestamp"]),
    "attachments": _flat_sql("attachments", ["bytes", "kind", "name"]),
    "labels": _flat_sql("labels", ["label", "score"]),
    "edits": _flat_sql("edits", ["edited_by", "old_text"]),
}


@query(_NODES + " UNION ALL ".join(f" SELECT record_id, '{e}' AS entity, path AS node_path FROM {n}" for n, e in LISTS.items()))
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    raw, tree = _tree(spark, d)
    return nested.node_paths(raw, "record_id", "payload", tree, LISTS)


def _flat(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        raw, tree = _tree(spark, d)
        return nested.flat_table(raw, "record_id", "payload", tree, name)

    run.__name__ = f"p2_{name or 'dialogues'}"
    return query(_FLAT_SQL.get(name))(run)


for _name in ("", *LISTS):
    _flat(_name)
