from __future__ import annotations

import json

from statuta.operators import nested

TREE = {"total_chunks": 1, "titles": [{"number": 21, "name": "Food", "chapters": [{"number": None, "name": " Office ", "parts": [{"number": " ", "name": "", "sections": [{"number": "1.1", "name": None, "chunks": [{"chunk_id": "c1", "metrics": [None, {"value": 3, "unit": "mg", "context": "x"}]}]}]}]}]}]}
FLAT = {"data": {"chunks": [
    {"chunk_id": "a", "hierarchy": json.dumps({"title": [{"number": 21.0}], "subpart": {"letter": "\tB"}, "section": {"number": "1.2"}}), "metrics": None},
    {"chunk_id": "a", "hierarchy": {"title": {"number": "21"}, "subpart": {"letter": "B"}, "section": {"number": "1.2"}}, "metrics": [{"value": "1", "unit": "g"}]},
    {"chunk_id": "b"}, {"chunk_id": " "}, None, {"chunk_id": "d", "hierarchy": "{broken"},
]}}


def nodes(payload):
    return {(r[2], r[3]) for r in nested.flatten(payload if payload is None or isinstance(payload, str) else json.dumps(payload))}


def test_tree_levels_hang_on_the_next_level_above():
    path = ["title:21", "title:21/chapter:Office", "title:21/chapter:Office/section:1.1", "title:21/chapter:Office/section:1.1/chunk:c1"]
    assert nodes(TREE) == set(zip(path, ["", *path])) | {(path[-1] + "/metric:2", path[-1])}


def test_flat_chunks_in_objects():
    top = "title:21/subpart:B/section:1.2"
    assert nodes(FLAT) == {("title:21", ""), ("title:21/subpart:B", "title:21"), (top, "title:21/subpart:B"), (top + "/chunk:a", top), (top + "/chunk:a/metric:1", top + "/chunk:a"), ("chunk:b", ""), ("chunk:d", "")}


def test_automaton_states():
    machine = nested.ShapeAutomaton()
    assert machine.run(TREE) == "branch" and machine.run(FLAT) == "holder" and machine.run([{"x": 1}]) == "opaque"
    assert machine.of(FLAT["data"]["chunks"][1]) == "chunk_with_path" and machine.of(FLAT["data"]["chunks"][2]) == "chunk_bare"


def test_what_does_not_parse_has_no_nodes():
    for payload in (None, "", "{", "null", "7", "[]", "{}", "[" * 100_000):
        assert nodes(payload) == set()


def test_no_field_of_a_chunk_is_lost(spark):
    chunk = {"chunk_id": "a", "text": "t", "cross_references_internal": ["1.1", "1.2"], "defines": None, "extra": {"x": 1}, "hierarchy": {"section": {"number": "1"}, "paragraph": ["a", "1"]}, "metrics": [{"value": 1}]}
    files = spark.createDataFrame([(1, json.dumps({"chunks": [chunk, {"chunk_id": "b", "text": ["é"], "hierarchy": "{broken"}, {"chunk_id": "c", "text": "u"}]}))], "file_id long, payload string")
    got = {r.chunk_id: r.attributes for r in nested.level_table(nested.subtype_tables(nested.flatten_nodes(files)), "chunk").collect()}
    assert {k: v and json.loads(v) for k, v in got.items()} == {"a": {"cross_references_internal": ["1.1", "1.2"], "extra": {"x": 1}, "hierarchy": {"paragraph": ["a", "1"]}}, "b": {"text": ["é"], "hierarchy": "{broken"}, "c": None}


def test_every_subtype_table_is_registered():
    import __spark_entry__ as driver

    assert {f"p1_{table}s" for table in (*nested.LEVELS, "chunk", "metric")} <= set(driver.queries())


def test_tables_are_distinct_and_linked(spark):
    rows = [(1, json.dumps(TREE), "x"), (1, json.dumps(TREE), "y"), (2, json.dumps(FLAT), None), (3, None, None), (None, json.dumps(TREE), None), (4, json.dumps([{"chunk_id": "z" * 10, "text": "long " * 200_000}]), None)]
    files = spark.createDataFrame(rows, "file_id long, payload string, level string")
    found = nested.flatten_nodes(files)
    got = [(r.file_id, r.node_key, r.parent_key) for r in found.collect()]
    assert len(got) == len(set(got)) and {f for f, _, _ in got} == {1, 2, 4}
    keys = {(f, k) for f, k, _ in got}
    assert all(not p or (f, p) in keys for f, _, p in got)
    tables = nested.subtype_tables(found)
    assert {(r.position, r.value, r.unit, r.attributes) for r in tables["measure"].where("file_id = 1").collect()} == {(2, "3", "mg", '{"context": "x"}')}
    assert tables["chunk_bare"].where("length(text) = 1000000").count() == 1 and nested.level_table(tables, "chapter").first().name == "Office"
    assert sorted((r.file_id, r.node_key, r.parent_key) for r in nested.common(tables).collect()) == sorted(got)
    assert nested.flatten_nodes(files.limit(0)).count() == 0


def test_variants_have_tables_of_their_own(spark):
    payload = {"parts": [{"number": "1", "sections": [{"number": "1.1"}, {"number": "1.2", "chunks": [{"chunk_id": "a", "metrics": [7, {"x": 1}, {"unit": "g"}, [1, 2]]}]}]}], "data": TREE["titles"][0]["chapters"], "loose": [{"chunk_id": "b", "hierarchy": {"title": {"number": 3}}}]}
    tables = nested.subtype_tables(nested.flatten_nodes(spark.createDataFrame([(1, json.dumps(payload))], "file_id long, payload string")))
    keys = lambda variant: {r.node_key for r in tables[variant].collect()}
    assert keys("branch") >= {"part:1", "part:1/section:1.2"} and keys("leaf") == {"part:1/section:1.1"} and keys("path") == {"title:3"}
    assert keys("chunk_with_path") == {"title:3/chunk:b"} and "part:1/section:1.2/chunk:a" in keys("chunk_bare")
    assert [(r.position, r.value) for r in tables["scalar"].orderBy("position").collect()] == [(1, "7"), (4, "[1, 2]")]
    assert [(r.position, r.attributes) for r in tables["record"].collect()] == [(2, '{"x": 1}')] and (3, None, "g", None) in {tuple(r)[4:] for r in tables["measure"].collect()}


def test_depth_and_chunks_in_chunks():
    deep = "[" * 3_000 + '{"chunk_id": "a"}' + "]" * 3_000
    assert nodes(deep) == {("chunk:a", "")}
    assert nodes({"chunk_id": "a", "chunks": [{"chunk_id": "b"}], "box": {"parts": [{"number": 2, "chunks": [{"chunk_id": "c"}]}]}}) == {("chunk:a", ""), ("chunk:a/chunk:b", "chunk:a"), ("chunk:a/part:2", "chunk:a"), ("chunk:a/part:2/chunk:c", "chunk:a/part:2")}
    wrapped = json.dumps(json.dumps([[[[{"title": {"number": "9"}}]]]]))
    assert nodes({"chunk_id": "a", "hierarchy": json.loads(wrapped)}) == {("title:9", ""), ("title:9/chunk:a", "title:9")}
