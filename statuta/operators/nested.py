"""Nested records into flat tables that keep parent and child links (problem 1).

A bottom-up tree automaton gives every JSON value a state from its own keys and the states of its
children. The states decide the structural variant of a node, and the variant routes it to a typed
table with the columns of that shape. All tables share the supertype's columns (file_id, node_key,
parent_key, level), and a parent's key is always the key of a row of some table or the empty string.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.runtime import cut

#: Levels from the top; each with the field that holds its key.
LEVELS = {"title": "number", "chapter": "number", "subchapter": "letter", "part": "number", "subpart": "letter", "section": "number"}
PLURALS = {f"{level}s": level for level in LEVELS} | {"chunks": "chunk"}
SCHEMA = (
    "file_id long, variant string, level string, node_key string, parent_key string, own_key string, name string, "
    "chunk_type string, cfr_citation string, text string, value string, unit string, attributes string"
)
#: Fields of a chunk with a place of their own; all others are kept in attributes, as JSON.
TYPED = ("chunk_id", "chunk_type", "cfr_citation", "text", "hierarchy", "metrics")
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]
#: The columns of each variant's table beside those that all tables share. branch and leaf are levels of
#: a tree with and without something below, path is a level named by a chunk; measure, record and scalar
#: are the shapes of a metric.
_CHUNK = {"chunk_id": "own_key", "chunk_type": "chunk_type", "cfr_citation": "cfr_citation", "text": "text", "attributes": "attributes"}
_LEVEL = {"key": "own_key", "name": "name"}
SUBTYPES = {
    "branch": _LEVEL,
    "leaf": _LEVEL,
    "path": _LEVEL,
    "chunk_with_path": _CHUNK,
    "chunk_bare": _CHUNK,
    "measure": {"position": "cast(own_key as int)", "value": "value", "unit": "unit", "attributes": "attributes"},
    "record": {"position": "cast(own_key as int)", "attributes": "attributes"},
    "scalar": {"position": "cast(own_key as int)", "value": "value"},
}
COMMON = ["file_id", "node_key", "parent_key", "level"]


def _unwrapped(value: object) -> object:
    """A value that was delivered as JSON text, or as a list of one, however often."""
    while True:
        if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
            try:
                value = json.loads(value)
            except (ValueError, RecursionError):
                return None
        elif isinstance(value, list) and len(value) == 1:
            value = value[0]
        else:
            return value


def _plain(value: object) -> str | None:
    """A scalar as trimmed text; null and blank give None, and whole numbers have no fraction."""
    if value is None or isinstance(value, (bool, dict, list)):
        return None
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return str(value).strip() or None


def _level_key(level: str, value: dict) -> str | None:
    return _plain(value.get(LEVELS[level])) or _plain(value.get("name"))


class ShapeAutomaton:
    """Deterministic bottom-up automaton over JSON values.

    Final states: ``scalar``, ``chunk_with_path`` (carries its own hierarchy), ``chunk_bare``,
    ``branch`` (has children under a plural level name), ``holder`` (leads to chunks or branches
    in some other way), ``measure`` (has a value or unit) and ``opaque`` (nothing below it is a
    node). A list has the strongest state of its members.
    """

    ORDER = ("scalar", "opaque", "measure", "holder", "branch", "chunk_bare", "chunk_with_path")
    LEADING = frozenset(ORDER[3:])

    def __init__(self) -> None:
        self.states: dict[int, str] = {}

    def run(self, value: object) -> str:
        """The state of ``value``; the states of all objects in it are kept by identity."""
        todo: list[tuple[object, bool]] = [(value, False)]
        while todo:
            node, ready = todo.pop()
            if not isinstance(node, (dict, list)):
                continue
            children = list(node.values()) if isinstance(node, dict) else node
            if not ready:
                todo.append((node, True))
                todo += [(child, False) for child in children]
            else:
                self.states[id(node)] = self._next(node, children)
        return self.of(value)

    def of(self, value: object) -> str:
        return self.states.get(id(value), "scalar")

    def _next(self, node: dict | list, children: list) -> str:
        below = {self.of(child) for child in children}
        if isinstance(node, list):
            return max(below, key=self.ORDER.index, default="opaque")
        if "chunk_id" in node:
            return "chunk_with_path" if node.get("hierarchy") is not None else "chunk_bare"
        if any(key in PLURALS and PLURALS[key] != "chunk" and isinstance(node[key], (list, dict)) for key in node):
            return "branch"
        if below & self.LEADING:
            return "holder"
        return "measure" if "value" in node or "unit" in node else "opaque"


def _text(rest: dict) -> str | None:
    return json.dumps(rest, ensure_ascii=False) if rest else None


def flatten(payload: str | None) -> Iterator[tuple]:
    """The distinct nodes of one payload, each after its parent; none if it does not parse.

    Depth is no matter: values are visited from a stack. What is nested in a chunk beside its own
    fields hangs on the chunk.
    """
    try:
        root = json.loads(payload) if payload is not None else None
    except (ValueError, RecursionError):
        return
    automaton = ShapeAutomaton()
    automaton.run(root)
    seen: set[str] = set()

    def node(variant: str, level: str, key: str, parent: str, **more: object) -> tuple[str, list[tuple]]:
        own = f"{parent}/{level}:{key}" if parent else f"{level}:{key}"
        if own in seen:
            return own, []
        seen.add(own)
        row = {"variant": variant, "level": level, "node_key": own, "parent_key": parent, "own_key": key} | more
        return own, [tuple(row.get(c) for c in COLUMNS[1:])]

    def chunk(value: dict, state: str, path: str) -> tuple[str, list[tuple]]:
        """The key that the chunk's children hang on, and its rows."""
        found: list[tuple] = []
        hierarchy = _unwrapped(value.get("hierarchy"))
        if isinstance(hierarchy, dict):
            path = ""
            for level in LEVELS:
                at = _unwrapped(hierarchy.get(level))
                if isinstance(at, dict) and (key := _level_key(level, at)):
                    path, rows = node("path", level, key, path, name=_plain(at.get("name")))
                    found += rows
        if (key := value.get("chunk_id")) is None or not str(key).strip():
            return path, found
        text = value.get("text")
        rest = {k: v for k, v in value.items() if k not in TYPED and v is not None}
        if text is not None and not isinstance(text, str):
            rest["text"] = text
        if (beside := {k: v for k, v in hierarchy.items() if k not in LEVELS and v is not None} if isinstance(hierarchy, dict) else hierarchy or value.get("hierarchy")):
            rest["hierarchy"] = beside
        own, rows = node(state, "chunk", str(key), path, chunk_type=_plain(value.get("chunk_type")), cfr_citation=_plain(value.get("cfr_citation")), text=text if isinstance(text, str) else None, attributes=_text(rest))
        found += rows
        metrics = value.get("metrics")
        for at, metric in enumerate(metrics if isinstance(metrics, list) else [metrics], 1):
            if isinstance(metric, dict):
                shape = "measure" if "value" in metric or "unit" in metric else "record"
                found += node(shape, "metric", str(at), own, value=_plain(metric.get("value")), unit=_plain(metric.get("unit")), attributes=_text({k: v for k, v in metric.items() if k not in ("value", "unit")}))[1]
            elif metric is not None:
                found += node("scalar", "metric", str(at), own, value=_text(metric) if isinstance(metric, list) else _plain(metric))[1]
        return own, found

    todo: list[tuple[object, str | None, str]] = [(root, None, "")]
    while todo:
        value, level, path = todo.pop()
        state = automaton.of(value)
        if isinstance(value, list):
            todo += [(item, level, path) for item in reversed(value)]
            continue
        if not isinstance(value, dict):
            continue
        inside = value.items()
        if state.startswith("chunk"):
            path, rows = chunk(value, state, path)
            yield from rows
            inside = [(k, v) for k, v in inside if k not in TYPED and automaton.of(v) in automaton.LEADING]
        elif level in LEVELS and (key := _level_key(level, value)):
            path, rows = node("branch" if state in automaton.LEADING else "leaf", level, key, path, name=_plain(value.get("name")))
            yield from rows
        todo += [(child, PLURALS.get(name), path) for name, child in reversed(inside) if name in PLURALS or automaton.of(child) in automaton.LEADING]


def flatten_nodes(files: DataFrame, id_column: str = "file_id", payload_column: str = "payload") -> DataFrame:
    """One row per (file, node) of all levels, in the common supertype layout of ``SCHEMA``.

    Payloads that are null, empty or do not parse give no rows; a level without key and name is
    left out and its children hang on the next level above; a chunk without chunk_id and its
    metrics are no nodes; repeated files and repeated nodes count once (the first attributes seen
    stay); other columns of ``files`` are ignored. Long payloads are parsed whole.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for file_id, payload in zip(batch["file_id"], batch["payload"]):
                rows += [(file_id, *node) for node in flatten(payload if isinstance(payload, str) else None)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=COLUMNS)

    source = files.select(F.col(id_column).cast("long").alias("file_id"), F.col(payload_column).cast("string").alias("payload"))
    return source.where("file_id is not null and payload is not null").mapInPandas(parse, SCHEMA).dropDuplicates(["file_id", "node_key"])


def subtype_tables(nodes: DataFrame, shared_only: bool = False) -> dict[str, DataFrame]:
    """The typed tables, one per variant of ``SUBTYPES``, each with the columns that all share.

    The nodes are parsed once and written in a folder per variant; a table reads its own folder. With
    ``shared_only`` the tables have no other columns, and texts are neither shuffled nor written.
    """
    routed = cut(nodes.select(*COMMON, "variant") if shared_only else nodes, "nodes", by="variant")
    own = lambda columns: [] if shared_only else [F.expr(e).alias(c) for c, e in columns.items()]
    return {variant: routed.where(F.col("variant") == variant).select(*COMMON, *own(columns)) for variant, columns in SUBTYPES.items()}


def common(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of all typed tables in the supertype's columns, with their variant."""
    found = None
    for variant, table in tables.items():
        part = table.select(*COMMON, F.lit(variant).alias("variant"))
        found = part if found is None else found.unionByName(part)
    return found


def level_table(tables: dict[str, DataFrame], level: str) -> DataFrame:
    """The nodes of a level (or chunk, or metric) from the tables of all its variants, columns a variant lacks null."""
    variants = ("chunk_with_path", "chunk_bare") if level == "chunk" else ("measure", "record", "scalar") if level == "metric" else ("branch", "leaf", "path")
    found = None
    for variant in variants:
        part = tables[variant].where(F.col("level") == level).drop("level").withColumn("variant", F.lit(variant))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found.withColumnRenamed("key", LEVELS[level]) if level in LEVELS else found
