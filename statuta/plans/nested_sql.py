"""DuckDB's SQL of problem 1: the same nodes by recursion over the JSON of each payload."""

from __future__ import annotations

from statuta.operators.nested import LEVELS, PLURALS


def _scalar(v: str) -> str:
    """Trimmed text of a scalar, whole numbers without fraction; null for blanks and other kinds."""
    kind, text = f"json_type({v})", f"json_extract_string({v}, '$')"
    return f"nullif(CASE WHEN {kind} = 'VARCHAR' THEN trim({text}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) WHEN {kind} = 'DOUBLE' AND ({v})::DOUBLE = floor(({v})::DOUBLE) THEN ({v})::DOUBLE::BIGINT::VARCHAR WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN ({v})::VARCHAR END, '')"


def _once(v: str) -> str:
    """What JSON text or a list of one holds, unwrapped once."""
    text = f"json_extract_string({v}, '$')"
    return rf"(CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({text}, '^\s*[{{\[]') THEN CASE WHEN json_valid({text}) THEN {text}::JSON END WHEN json_type({v}) = 'ARRAY' AND json_array_length({v}) = 1 THEN json_extract({v}, '$[0]') ELSE {v} END)"


def _key(v: str, level: str) -> str:
    at = lambda field: _scalar(f"json_extract({v}, '$.{field}')")
    return f"coalesce({at(LEVELS[level])}, {at('name')})"


_OWN = "CASE c.l " + " ".join(f"WHEN '{level}' THEN {_key('c.v', level)}" for level in LEVELS) + " END"
_PLURAL = "CASE k " + " ".join(f"WHEN '{name}' THEN '{level}'" for name, level in PLURALS.items() if level in LEVELS) + " END"
_HIERARCHY = _once(_once(_once("json_extract(v, '$.hierarchy')")))
_AT = ", ".join(f"CASE WHEN json_type(h) = 'OBJECT' THEN {_once(_once(f'json_extract(h, {chr(39)}$.{level}{chr(39)})'))} END AS h_{level}" for level in LEVELS)
_NAMES = ", ".join(f"CASE WHEN json_type(h_{level}) = 'OBJECT' THEN '{level}:' || {_key(f'h_{level}', level)} END AS n_{level}" for level in LEVELS)
_PATH = "[" + ", ".join(f"n_{level}" for level in LEVELS) + "]"
_METRICS = "CASE json_type(json_extract(v, '$.metrics')) WHEN 'ARRAY' THEN json_extract(v, '$.metrics[*]') ELSE [json_extract(v, '$.metrics')] END"

#: nodes(file_id, level, node_key, parent_key, own_key): every value is visited, chunks are not searched for chunks.
NODES = f"""
WITH RECURSIVE f AS (SELECT DISTINCT file_id, payload::JSON AS v FROM chunk_files WHERE file_id IS NOT NULL AND json_valid(payload)),
w AS (
  SELECT file_id, v, NULL::VARCHAR AS l, '' AS path, NULL::VARCHAR AS parent, NULL::VARCHAR AS own FROM f
  UNION ALL
  SELECT file_id, v, l, CASE WHEN own IS NULL THEN path ELSE concat(CASE WHEN path <> '' THEN path || '/' ELSE '' END, l, ':', own) END, CASE WHEN own IS NOT NULL THEN path END, own
  FROM (SELECT file_id, c.v, c.l, path, CASE WHEN json_type(c.v) = 'OBJECT' AND NOT json_exists(c.v, '$.chunk_id') THEN {_OWN} END AS own
    FROM (SELECT file_id, path, unnest(CASE json_type(v)
        WHEN 'ARRAY' THEN list_transform(json_extract(v, '$[*]'), lambda e: struct_pack(v := e, l := l))
        WHEN 'OBJECT' THEN CASE WHEN NOT json_exists(v, '$.chunk_id') THEN list_transform(json_keys(v), lambda k: struct_pack(v := json_extract(v, '$."' || k || '"'), l := {_PLURAL})) END END) AS c FROM w)
    WHERE json_type(c.v) IN ('ARRAY', 'OBJECT'))),
c1 AS (SELECT file_id, v, path, {_HIERARCHY} AS h FROM w WHERE json_type(v) = 'OBJECT' AND json_exists(v, '$.chunk_id')),
c2 AS (SELECT file_id, v, path, h, {_AT} FROM c1),
c3 AS (SELECT file_id, v, path, h, {_NAMES} FROM c2),
c4 AS (SELECT file_id, v, path, CASE WHEN json_type(h) = 'OBJECT' THEN list_filter({_PATH}, lambda x: x IS NOT NULL) END AS ns FROM c3),
c5 AS (SELECT file_id, v, ns, coalesce(array_to_string(ns, '/'), path) AS above, coalesce(json_extract_string(v, '$.chunk_id'), '') AS id FROM c4),
c6 AS (SELECT *, concat(CASE WHEN above <> '' THEN above || '/' ELSE '' END, 'chunk:', id) AS key FROM c5 WHERE trim(id) <> ''),
m AS (SELECT file_id, key, unnest({_METRICS}) AS x, generate_subscripts({_METRICS}, 1) AS n FROM c6),
nodes AS (
  SELECT file_id, l AS level, path AS node_key, parent AS parent_key, own AS own_key FROM w WHERE own IS NOT NULL
  UNION SELECT file_id, split_part(ns[i], ':', 1), array_to_string(ns[1:i], '/'), coalesce(array_to_string(ns[1:i - 1], '/'), ''), ns[i][position(':' IN ns[i]) + 1:] FROM (SELECT file_id, ns, unnest(range(1, len(ns) + 1)) AS i FROM c5 WHERE ns IS NOT NULL)
  UNION SELECT file_id, 'chunk', key, above, id FROM c6
  UNION SELECT file_id, 'metric', key || '/metric:' || n, key, n::VARCHAR FROM m WHERE json_type(x) <> 'NULL')
"""
