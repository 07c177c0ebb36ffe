"""Deeply nested records into related flat tables, by shared inlining.

Shared inlining (Shanmugasundaram et al., VLDB 1999) looks at the graph of element types rather than at
single documents: an element type that occurs at most once below exactly one parent type is inlined into
its parent's table; one that is repeated, shared by several parents or part of a cycle gets a table of its
own, whose rows carry a foreign key to the row that holds them.

Three steps, each usable alone:

* `infer_schema_graph` reads every record once and returns the edges of the schema graph;
* `plan_inlining` decides which element types become tables;
* `shred` turns the records into the rows of one of these tables.

Records whose shape drifts are read leniently: a container may be written as a JSON string (at any depth,
also the whole record), a list may be written as an object with the keys "0", "1", ..., and a single object
may stand for a list of one.

Defined results for odd input: a null, empty or invalid record gives no rows (`valid_records` tells them
apart); an empty table gives an empty table; repeated records give their rows again, told apart by the key
columns the caller names; a name used both for scalars and for objects is a column and a table. Texts of
any length are read whole. Columns that aren't named as keys are not looked at, so clashing names are harmless.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "record"


def _decoded(value: object) -> object:
    """A container written as a JSON string becomes that container; anything else stays."""
    # Each decoding makes the text shorter, so this ends.
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def parse_record(text: str | None) -> object:
    """The record a text holds, or None if it is null or not valid JSON."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return _decoded(value)


def _members(value: object) -> list[dict] | None:
    """The objects a value stands for; None if it is a scalar (or a list of scalars)."""
    value = _decoded(value)
    if isinstance(value, dict):
        if value and all(k.isdigit() for k in value):
            return [v for k in sorted(value, key=int) for v in _members(value[k]) or []]
        return [value]
    if isinstance(value, list):
        found = [m for v in value for m in _members(v) or []]
        return found if found or not value else None
    return None


def _scalar(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False)
    return str(value)


@dataclass
class SchemaGraph:
    """Element types (by name), their parent-child edges and the scalar attributes seen."""

    edges: dict[tuple[str, str], int] = field(default_factory=dict)  #: (parent, child) -> most children in one parent
    attributes: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))

    def nodes(self) -> list[str]:
        return sorted({ROOT, *(p for p, _ in self.edges), *(c for _, c in self.edges)})

    def children(self, node: str) -> list[str]:
        return sorted(c for p, c in self.edges if p == node)

    def recursive(self, node: str) -> bool:
        seen, todo = set(), self.children(node)
        while todo:
            n = todo.pop()
            if n == node:
                return True
            if n not in seen:
                seen.add(n)
                todo += self.children(n)
        return False


@dataclass
class InliningPlan:
    """tables: element types with a table of their own -> columns as (path below the table's element, column name)."""

    tables: dict[str, list[tuple[tuple[str, ...], str]]]
    why: dict[str, str]


def _facts(record: object) -> Iterator[tuple[str, str, bool, int]]:
    todo = [(ROOT, m) for m in _members(record) or []]
    while todo:
        name, obj = todo.pop()
        for key, value in obj.items():
            members = _members(value)
            if members is None:
                if value is not None:
                    yield name, key, False, 1
            else:
                if members:
                    yield name, key, True, len(members)
                todo += [(key, m) for m in members]


def infer_schema_graph(df: DataFrame, json_col: str, max_edges: int = 10_000) -> SchemaGraph:
    """The schema graph of all records of `df`.

    Edges are reduced inside each partition and again by a group-by, so the driver receives one row for
    each edge of the schema, however many records there are. A schema of more than `max_edges` edges (data
    values used as keys) is an error, not a silent cut.
    """

    def edges(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[str, str, bool], int] = {}
        for batch in batches:
            for text in batch[json_col]:
                for parent, child, nested, n in _facts(parse_record(text)):
                    if best.get((parent, child, nested), 0) < n:
                        best[parent, child, nested] = n
        yield pd.DataFrame([(p, c, o, n) for (p, c, o), n in best.items()], columns=["parent", "child", "nested", "most"])

    found = df.select(F.col(json_col).cast("string").alias(json_col)).mapInPandas(edges, "parent string, child string, nested boolean, most int")
    rows = found.groupBy("parent", "child", "nested").agg(F.max("most").alias("most")).limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"the schema has more than {max_edges} edges: keys seem to hold data")
    graph = SchemaGraph()
    for r in rows:
        if r["nested"]:
            graph.edges[r["parent"], r["child"]] = r["most"]
        else:
            graph.attributes[r["parent"]].add(r["child"])
    return graph


def plan_inlining(graph: SchemaGraph, own_tables: Iterable[str] = ()) -> InliningPlan:
    """Which element types become tables, and what is inlined into them. `own_tables` are never inlined."""
    parents = defaultdict(set)
    for p, c in graph.edges:
        parents[c].add(p)
    why = {ROOT: "root"}
    for node in graph.nodes():
        if node in why:
            continue
        if graph.recursive(node):
            why[node] = "recursive"
        elif any(n > 1 for (_, c), n in graph.edges.items() if c == node):
            why[node] = "repeated"
        elif len(parents[node]) > 1:
            why[node] = "shared"
        elif node in own_tables:
            why[node] = "asked for"
    tables = {}
    for table in why:
        columns, todo = [], [((), table)]
        while todo:
            path, node = todo.pop(0)
            columns += [((*path, a), "_".join((*path, a))) for a in sorted(graph.attributes.get(node, ()))]
            todo += [((*path, c), c) for c in graph.children(node) if c not in why]
        taken: dict[str, int] = {}
        for i, (path, name) in enumerate(columns):
            low = name.lower()
            taken[low] = taken.get(low, 0) + 1
            columns[i] = (path, name if taken[low] == 1 else f"{name}_{taken[low]}")
        tables[table] = columns
    return InliningPlan(tables, why)


def _rows(record: object, table: str, tables: set[str], key: str | None) -> Iterator[tuple[dict, str, str | None, str | None, str | None]]:
    """(object, its key, parent's table, parent's key, natural key of the nearest ancestor in the same table)."""
    todo = [(ROOT, m, str(i), None, None, None) for i, m in enumerate(_members(record) or [])]
    while todo:
        name, obj, at, up, up_key, held_by = todo.pop()
        if name == table:
            yield obj, at, up, up_key, held_by
        if name in tables:
            up, up_key = name, at
        inner = held_by
        if name == table and key and obj.get(key) is not None and not isinstance(obj.get(key), (dict, list)):
            inner = str(obj[key])
        for k, v in obj.items():
            if v is None or isinstance(v, (bool, int, float)):
                continue
            for i, m in enumerate(_members(v) or []):
                todo.append((k, m, f"{at}/{k}{i}", up, up_key, inner))


def shred(df: DataFrame, json_col: str, plan: InliningPlan, table: str, keys: Iterable[str] = (), natural_key: str | None = None) -> DataFrame:
    """The rows of one table of `plan`, one narrow pass over the records without a shuffle.

    Columns: `keys` as they stand in `df`; _key, the row's place in its record; _parent_table and
    _parent_key, the row that holds it; _held_by, the `natural_key` of the nearest ancestor in the same
    table (null if the record itself holds it); then the table's columns as text.
    """
    keys = list(keys)
    columns = plan.tables[table]
    names, tables = [c for _, c in columns], set(plan.tables)
    own = ["_key", "_parent_table", "_parent_key", "_held_by"]
    if len({n.lower() for n in [*keys, *own, *names]}) < len([*keys, *own, *names]):
        columns = [(p, f"{table}_{c}" if c.lower() in {x.lower() for x in [*keys, *own]} else c) for p, c in columns]
        names = [c for _, c in columns]

    def value(obj: dict, path: tuple[str, ...]) -> str | None:
        for step in path[:-1]:
            inner = _members(obj.get(step))
            if not inner:
                return None
            obj = inner[0]
        v = obj.get(path[-1])
        return None if isinstance(v, (dict, list)) and _members(v) is not None else _scalar(v)

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places, found = [], []
            for i, text in enumerate(batch["__json"]):
                for obj, at, up, up_key, held_by in _rows(parse_record(text), table, tables, natural_key):
                    places.append(i)
                    found.append((at, up, up_key, held_by, *(value(obj, p) for p, _ in columns)))
            out = pd.DataFrame(found, columns=[*own, *names], dtype=object)
            if keys:
                out = pd.concat([batch[keys].iloc[places].reset_index(drop=True), out], axis=1)
            yield out

    source = df.select(*[F.col(k) for k in keys], F.col(json_col).cast("string").alias("__json"))
    schema = T.StructType([*(source.schema[k] for k in keys), *(T.StructField(n, T.StringType()) for n in [*own, *names])])
    return source.mapInPandas(rows, schema)


def valid_records(df: DataFrame, json_col: str) -> DataFrame:
    """`df` with is_valid: whether the text parses as JSON (null where it is null), decided in the JVM."""
    return df.withColumn("is_valid", F.when(F.col(json_col).isNotNull(), F.try_parse_json(F.col(json_col)).isNotNull()))
