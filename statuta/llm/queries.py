"""The pN_ queries of the problems on texts and vectors, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import leaks, neardup, packing, split, subjects, vectors
from statuta.runtime import read


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.most_similar(read(spark, folder, "points"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.similar_pairs(p2_neighbours(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.chunk_pairs(*neardup.near_duplicates(read(spark, folder, "search_results")))


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.linked_members(*neardup.near_duplicates(read(spark, folder, "search_results")))


def _pieces(spark: SparkSession, folder: str, strategy: str) -> DataFrame:
    return split.split_items(split.oversized(read(spark, folder, "search_results")), strategy)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, "fill").select("chunk_id", "piece_no", "start_char")


def p5_bisected(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, "bisect").drop("piece")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_items(packing.read_counts(spark, read(spark, folder, "documents")))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, folder))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(read(spark, folder, "documents"), read(spark, folder, "eval_items"), ("passage", "question", "answer"), short=True)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.find_leaks(read(spark, folder, "documents"), read(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_areas(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_areas(*(read(spark, folder, t) for t in ("documents", "subject_examples", "subjects")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_areas(spark, folder).where(F.col("posterior") >= subjects.POSTERIOR).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(p9_areas(spark, folder), read(spark, folder, "documents").count())


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p4_found, p4_members, p5_found, p5_bisected, p7_containers, p7_fill, p8_found, p8_spans, p9_found, p9_areas, p9_composition)}
_COUNT = r"len(list_filter(string_split_regex({0}, '[\s\x{{00a0}}]+'), lambda w: w <> ''))"
_NEAREST = """
WITH p AS (SELECT point_id, cfr_dense AS v FROM points WHERE point_id IS NOT NULL AND len(cfr_dense) = 64
    AND list_bool_and(list_transform(cfr_dense, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(cfr_dense, lambda x: x <> 0))
    QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY embedded_at DESC) = 1),
s AS (SELECT a.point_id AS a, b.point_id AS b, round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 9) AS s FROM p a, p b WHERE a.point_id <> b.point_id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM s QUALIFY rank <= 5)
"""
_SIMILAR = r"""
WITH c AS (SELECT chunk_id, max(text) AS text, max(nullif(regexp_replace(lower(defines), '[\s\x{00a0}\-]+', '', 'g'), '')) AS term FROM search_results GROUP BY chunk_id),
w AS (SELECT chunk_id, term, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM c),
d AS (SELECT chunk_id, term, list_sort(list_distinct(w)) AS w FROM w WHERE len(w) >= 12),
e AS (SELECT chunk_id, unnest(w) AS x FROM d),
i AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.chunk_id < b.chunk_id GROUP BY ALL),
p AS (SELECT i.a, i.b FROM i JOIN d p ON p.chunk_id = i.a JOIN d q ON q.chunk_id = i.b
  WHERE n * 10 >= 7 * (len(p.w) + len(q.w) - n) AND (p.term IS NULL OR q.term IS NULL OR p.term = q.term))
"""
_PIECES = rf"""
WITH RECURSIVE r AS (SELECT chunk_id, coalesce(max(section_preamble), '') AS preamble, max_by(struct_pack(t := text, o := overflow_chunks), length(text)) AS x FROM search_results WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
p AS (SELECT chunk_id, preamble, list_concat([struct_pack(chunk_id := chunk_id, text := x.t)], coalesce(x.o, [])) AS parts FROM r),
k AS (SELECT chunk_id, preamble, list_filter(parts, lambda y: coalesce(y.text, '') <> '') AS parts FROM p),
j AS (SELECT chunk_id, {_COUNT.format('preamble')} AS before, array_to_string(list_transform(list_filter(parts, lambda y, i: y.chunk_id IS NULL OR list_position(list_transform(parts, lambda z: z.chunk_id), y.chunk_id) = i), lambda y: y.text), ' ') AS whole FROM k),
long AS (SELECT *, 297 - before AS room FROM j WHERE whole <> '' AND {_COUNT.format('whole')} + before > 297),
s0 AS (SELECT chunk_id, room, string_split(regexp_replace(whole, '([.!?])([\s\x{{00a0}}]+)([A-Z(])', '\1' || chr(30) || '\2' || chr(31) || '\3', 'g'), chr(31)) AS list FROM long),
s1 AS (SELECT chunk_id, room, generate_subscripts(list, 1) AS n, unnest(list) AS raw FROM s0),
s2 AS (SELECT chunk_id, room, n, split_part(raw, chr(30), 1) AS s, coalesce(sum(length(raw) - CASE WHEN contains(raw, chr(30)) THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s1),
s3 AS (SELECT *, {_COUNT.format('s')} AS words FROM s2),
t0 AS (SELECT chunk_id, room, n, start, words, list_filter(regexp_extract_all(s, '[^\s\x{{00a0}}]+|[\s\x{{00a0}}]+'), lambda y: y <> '') AS tokens FROM s3 WHERE words > greatest(1, room)),
t1 AS (SELECT chunk_id, room, n, start, words, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM t0),
t2 AS (SELECT *, start + coalesce(sum(length(token)) OVER (PARTITION BY chunk_id, n ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_at, regexp_matches(token, '^[^\s\x{{00a0}}]') AS is_word FROM t1),
t3 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, n ORDER BY pos) - 1 AS w FROM t2 WHERE is_word),
units AS (
  SELECT chunk_id, room, n, 0 AS sub, start, words FROM s3 WHERE words <= greatest(1, room)
  UNION ALL SELECT chunk_id, room, n, w // greatest(1, room), CASE WHEN w = 0 THEN start ELSE char_at END, least(greatest(1, room), words - w) FROM t3 WHERE w % greatest(1, room) = 0),
u AS (SELECT chunk_id, room, start, words, row_number() OVER (PARTITION BY chunk_id ORDER BY n, sub) AS i, lag(start) OVER (PARTITION BY chunk_id ORDER BY n, sub) AS prev_start, lag(words) OVER (PARTITION BY chunk_id ORDER BY n, sub) AS prev FROM units),
f AS (
  SELECT chunk_id, i, 1 AS piece_no, start AS start_char, words AS used FROM u WHERE i = 1
  UNION ALL
  SELECT u.chunk_id, u.i, CASE WHEN fits THEN piece_no ELSE piece_no + 1 END, CASE WHEN fits THEN start_char WHEN again THEN prev_start ELSE start END, CASE WHEN fits THEN used + words WHEN again THEN prev + words ELSE words END
  FROM (SELECT u.*, f.piece_no, f.start_char, f.used, f.used + u.words <= u.room AS fits, greatest(1, floor(u.prev * 1.35)) <= 60 AND u.prev + u.words <= u.room AS again FROM f JOIN u ON u.chunk_id = f.chunk_id AND u.i = f.i + 1) u)
"""
_SPANS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, string_split_regex(text, '[\p{L}\p{N}]+') AS g FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dw AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS raw, unnest(g[1:len(w)]) AS gap FROM d),
dp AS (SELECT doc_id, i, lower(raw) AS word, sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id ORDER BY i) AS end_char, end_char - length(raw) AS start_char FROM dw),
q AS (SELECT item_id, field, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT item_id, unnest(['passage', 'question', 'answer']) AS field, unnest([passage, question, answer]) AS text FROM eval_items WHERE item_id IS NOT NULL) WHERE text IS NOT NULL),
qw AS (SELECT item_id, field, generate_subscripts(w, 1) AS j, unnest(w) AS word FROM q),
dg AS (SELECT doc_id, i, string_agg(word, ' ') OVER r AS gram, count(*) OVER r AS n FROM dp WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
qg AS (SELECT item_id, field, j, string_agg(word, ' ') OVER r AS gram, count(*) OVER r AS n FROM qw WINDOW r AS (PARTITION BY item_id, field ORDER BY j ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
hits AS (SELECT doc_id, item_id, field, i, j FROM dg JOIN qg USING (gram) WHERE dg.n = 12 AND qg.n = 12),
runs AS (SELECT doc_id, item_id, field, min(i) AS first, max(i) + 11 AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, field, i - j ORDER BY i) AS g FROM hits) GROUP BY doc_id, item_id, field, i - j, g),
short AS (SELECT DISTINCT item_id, field, w FROM q WHERE len(w) BETWEEN 1 AND 11),
brief AS (SELECT dp.doc_id, s.item_id, s.field, dp.i AS first, dp.i + len(s.w) - 1 AS last FROM short s JOIN dp ON dp.word = s.w[1] JOIN d ON d.doc_id = dp.doc_id WHERE list_transform(d.w[dp.i : dp.i + len(s.w) - 1], lambda x: lower(x)) = s.w),
spans AS (SELECT r.doc_id, item_id, field, a.start_char::INT AS start_char, b.end_char::INT AS end_char FROM (SELECT * FROM runs UNION ALL SELECT * FROM brief) r JOIN dp a ON a.doc_id = r.doc_id AND a.i = r.first JOIN dp b ON b.doc_id = r.doc_id AND b.i = r.last)
"""
ORACLE: dict[str, str] = {
    "p2_found": _NEAREST + "SELECT DISTINCT least(a, b) AS point_id_a, greatest(a, b) AS point_id_b FROM t WHERE s >= 0.85",
    # Equal while the points are one region, as at the smallest scales; beyond that hashing finds a little less.
    "p2_neighbours": _NEAREST + "SELECT a AS point_id, rank, b AS neighbour_id, s AS similarity FROM t",
    "p4_found": _SIMILAR + "SELECT a AS chunk_id_a, b AS chunk_id_b FROM p",
    "p4_members": _SIMILAR
    + """, l AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY 1)
SELECT chunk_id, min(chunk_id) OVER (PARTITION BY d.w) AS class_id, count(*) OVER (PARTITION BY d.w) AS n_copies, coalesce(n, 0) AS n_links FROM d LEFT JOIN l ON id = chunk_id""",
    "p5_found": _PIECES + "SELECT DISTINCT chunk_id, piece_no, start_char::INT AS start_char FROM f",
    "p8_found": _SPANS + "SELECT DISTINCT doc_id, item_id FROM spans WHERE field = 'passage'",
    "p8_spans": _SPANS + "SELECT doc_id, item_id, field, start_char, end_char FROM spans",
}
