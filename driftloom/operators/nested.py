"""Deeply nested JSON payloads to flat, linked tables.

One pass over all payloads infers a merged schema (every path with the kinds of value seen there); from it each list
of objects becomes a child table that carries the record's key, its own position path and its parent's. The
flattening itself is one narrow JVM stage per table (VARIANT expressions, no shuffle, no Python).

Defined cases: a null payload, text that is no JSON and JSON with anything after the first value give no row. A repeated
key keeps its last value. A list may be an array, a lone object or text that holds either. Nulls and plain values
inside a list are skipped and not counted. Lists of one name that a record holds in several places are one list, in the order of the places. Objects with no list give a parent row and no child row. Field names that
clash with the key columns, or with each other after flattening, get a ``_`` appended.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closes the wrapped payload; a payload is valid only if exactly one value stands before it.
_MARK = "driftloom: end of payload"


@dataclass
class Level:
    """A list of objects: the object chains that lead to it, its scalar fields and its own lists."""

    name: str
    routes: list[tuple[str, ...]]
    scalars: list[tuple[str, ...]] = field(default_factory=list)
    children: list["Level"] = field(default_factory=list)


def _parse(text: str) -> str:
    """SQL: the one JSON value of ``text`` as VARIANT, null where it isn't exactly one."""
    wrapped = f"""try_variant_get(try_parse_json('[' || {text} || ',"{_MARK}"]'), '$', 'array<variant>')"""
    return f"""get(filter(array({wrapped}), w -> size(w) = 2 AND try_variant_get(w[1], '$', 'string') = '{_MARK}'), 0)[0]"""


def _object(v: str) -> str:
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def _list(v: str, depth: int) -> str:
    """SQL: the objects of a list given as array, lone object or JSON text, as array<map<string,variant>>."""
    text, e = _parse(f"try_variant_get({v}, '$', 'string')"), f"e{depth}"
    arr = lambda x: f"try_variant_get({x}, '$', 'array<variant>')"
    whole = f"coalesce({arr(v)}, if({_object(v)} IS NOT NULL, array({v}), NULL), {arr(text)}, array({text}))"
    return f"filter(transform({whole}, {e} -> {_object(e)}), {e} -> {e} IS NOT NULL)"


def _step(m: str, route: tuple[str, ...]) -> str:
    """SQL: the variant at a chain of keys below the map ``m``."""
    for i, key in enumerate(route):
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        m = f"{m}['{quoted}']" if i == 0 else f"{_object(m)}['{quoted}']"
    return m


def _children(m: str, level: Level, depth: int) -> str:
    """SQL: the objects of ``level`` inside the map ``m``, those of all its routes one after another, shorter routes first."""
    lists = [_list(_step(m, r), depth) for r in level.routes]
    return lists[0] if len(lists) == 1 else "concat(" + ", ".join(f"coalesce({x}, array())" for x in lists) + ")"


def _kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, kind, n) over a partition. Path parts are JSON text; ``[]`` stands for the objects of a list."""
    seen: Counter = Counter()

    def walk(v: object, path: tuple[str, ...]) -> None:
        if isinstance(v, str) and v[:1].strip() in ("", "[", "{") and path:
            try:
                held = json.loads(v)
            except ValueError:
                held = None
            if isinstance(held, list | dict):
                seen[path, "text of list" if isinstance(held, list) else "text of object"] += 1
                if isinstance(held, list):
                    v = held
        if isinstance(v, dict):
            seen[path, "object"] += 1
            for k, x in v.items():
                walk(x, (*path, k))
        elif isinstance(v, list):
            objects = [x for x in v if isinstance(x, dict)]
            seen[path, "list of objects" if objects else "list"] += 1
            for x in objects:
                walk(x, (*path, "[]"))
        else:
            seen[path, "null" if v is None else "scalar"] += 1

    for pdf in batches:
        for text in pdf.iloc[:, 0]:
            try:
                value = json.loads(text)
            except (TypeError, ValueError, RecursionError):
                continue
            walk(value, ())
    yield pd.DataFrame(
        [(json.dumps(p), k, n) for (p, k), n in seen.items()], columns=["path", "kind", "n"]
    ).astype({"path": "string", "kind": "string", "n": "int64"})


def infer_merged_schema(df: DataFrame, payload: str, max_paths: int = 10_000) -> dict[tuple[str, ...], dict[str, int]]:
    """Every path of all payloads with the kinds of value seen there and how often.

    One scan; each partition sends only its distinct paths. More than ``max_paths`` paths mean that data is used as
    keys, which is an error, not a table.
    """
    rows = (
        df.select(payload).where(F.col(payload).isNotNull()).mapInPandas(_kinds, "path string, kind string, n long")
        .groupBy("path", "kind").agg(F.sum("n").alias("n"))
    )
    by_path = rows.groupBy("path").agg(F.collect_list(F.struct("kind", "n")).alias("kinds")).limit(max_paths + 1).collect()  # at most seven kinds a path
    if len(by_path) > max_paths:
        raise ValueError(f"more than {max_paths} paths in {payload}: its keys look like data")
    merged: dict[tuple[str, ...], dict[str, int]] = {}
    for r in by_path:
        merged[tuple(json.loads(r["path"]))] = {x["kind"]: x["n"] for x in r["kinds"]}
    return dict(sorted(merged.items()))


def plan_levels(schema: dict[tuple[str, ...], dict[str, int]], lists: frozenset[str] = frozenset()) -> Level:
    """The tree of lists in a merged schema; lists of one name below the same parent are one level.

    A field is a list if any record holds one there; ``lists`` names fields that are lists even where all records seen
    hold lone objects.
    """

    def kinds(at: list[tuple[str, ...]], route: tuple[str, ...]) -> set[str]:
        return {k for p in at for k in schema.get((*p, *route), {})}

    def is_list(at: list[tuple[str, ...]], route: tuple[str, ...]) -> bool:
        found = kinds(at, route)
        if route[-1] in lists and found & {"object", "text of object"}:
            return True
        return bool({"list of objects", "text of list"} & found)

    def below(path: tuple[str, ...]) -> list[tuple[str, ...]]:
        return [p for p in schema if len(p) == len(path) + 1 and p[: len(path)] == path]

    def fill(level: Level, at: list[tuple[str, ...]]) -> Level:
        found_lists: dict[str, list[tuple[tuple[str, ...], tuple[str, ...]]]] = {}

        def descend(path: tuple[str, ...], route: tuple[str, ...]) -> None:
            for p in below(path):
                r = (*route, p[-1])
                if p[-1] == "[]":
                    continue
                if is_list(at, r):
                    found_lists.setdefault(p[-1], []).append((r, p))
                else:
                    if {"scalar", "list", "text of object"} & schema[p].keys() and r not in level.scalars:
                        level.scalars.append(r)
                    descend(p, r)

        for path in at:
            descend(path, ())
        for name, found in sorted(found_lists.items()):
            routes = sorted({r for r, _ in found}, key=lambda r: (len(r), r))
            # a lone object is a list of one, so a list's objects are found at the path itself and below []
            spots = [q for _, p in found for q in (p, (*p, "[]")) if q in schema]
            level.children.append(fill(Level(name, routes), spots))
        return level

    return fill(Level("", [()]), [()])


def _root(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows of (_key, _node): each payload that is one JSON object."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    quoted = "`" + payload.replace("`", "``") + "`"
    one = df.select(F.col(key).alias("_key"), F.expr(_object(_parse(quoted))).alias("_node"))
    return one.where("_node IS NOT NULL")


def _find(root: Level, name: str) -> list[Level]:
    """The chain of levels from the root down to ``name``."""
    if root.name == name:
        return [root]
    for child in root.children:
        if chain := _find(child, name):
            return [root, *chain]
    return []


def node_paths(df: DataFrame, key: str, payload: str, root: Level, names: dict[str, str]) -> DataFrame:
    """(key, entity, node_path) for every object of every list in ``names``, in one scan without a shuffle."""

    def gather(m: str, path: str | None, level: Level, depth: int) -> list[str]:
        parts = []
        for i, child in enumerate(c for c in level.children if c.name in names or c.children):
            x, n = f"x{depth}_{i}", f"n{depth}_{i}"
            here = f"concat({path}, '.', cast({n} AS string))" if path else f"cast({n} AS string)"
            own = [f"array(named_struct('entity', '{names[child.name]}', 'node_path', {here}))"] if child.name in names else []
            inner = gather(x, here, child, depth + 1)
            both = own + inner
            one = both[0] if len(both) == 1 else "concat(" + ", ".join(both) + ")"
            parts.append(f"coalesce(flatten(transform({_children(m, child, depth)}, ({x}, {n}) -> {one})), array())")
        return parts

    parts = gather("_node", None, root, 0)
    if not parts:
        return df.select(F.col(key), F.lit("").alias("entity"), F.lit("").alias("node_path")).limit(0)
    found = "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]
    nodes = _root(df, key, payload).select(F.col("_key").alias(key), F.explode(F.expr(found)).alias("_found"))
    return nodes.select(key, "_found.entity", "_found.node_path")


def flat_table(df: DataFrame, key: str, payload: str, root: Level, name: str = "") -> DataFrame:
    """One flat table: the records themselves (``name`` empty) or the objects of one list.

    Columns: ``key``, and for a list ``node_path``, ``parent_path`` (null right below the record) and ``ordinal``; then
    every scalar field as text, joined names for fields of nested objects; a field that holds an object is null itself.
    """
    chain = _find(root, name)
    if not chain:
        raise KeyError(f"no list named {name!r}: {[c.name for c in root.children]}")
    rows = _root(df, key, payload).select("_key", "_node", F.lit(None).cast("string").alias("_path"), F.lit(None).cast("string").alias("_parent"), F.lit(None).cast("int").alias("_n"))
    for depth, level in enumerate(chain[1:]):
        rows = rows.select("_key", F.col("_path").alias("_parent"), F.posexplode(F.expr(_children("_node", level, depth))).alias("_n", "_node"))
        rows = rows.select("_key", "_node", F.concat_ws(".", "_parent", F.col("_n").cast("string")).alias("_path"), "_parent", "_n")
    taken = {key.lower()} | ({"node_path", "parent_path", "ordinal"} if name else set())
    out: list[Column] = [F.col("_key").alias(key)]
    if name:
        out += [F.col("_path").alias("node_path"), F.col("_parent").alias("parent_path"), F.col("_n").alias("ordinal")]
    for route in chain[-1].scalars:
        label = "_".join(route)
        while label.lower() in taken:
            label += "_"
        taken.add(label.lower())
        value, deeper = _step("_node", route), any(other[: len(route)] == route and len(other) > len(route) for other in chain[-1].scalars)
        text = f"try_variant_get({value}, '$', 'string')"
        # where some records hold an object, its fields are columns of their own
        out.append(F.expr(f"if({_object(value)} IS NOT NULL, NULL, {text})" if deeper else text).alias(label))
    return rows.select(*out)


def flatten(df: DataFrame, key: str, payload: str, lists: frozenset[str] = frozenset()) -> dict[str, DataFrame]:
    """All flat tables of a payload column by list name; the records are under ``''``."""
    root = plan_levels(infer_merged_schema(df, payload), lists)
    names: list[str] = []

    def walk(level: Level) -> None:
        names.append(level.name)
        for c in level.children:
            walk(c)

    walk(root)
    return {n: flat_table(df, key, payload, root, n) for n in names}
