"""Queries of the engine's own operators over the driver's tables, each with its SQL.

Every query reads whole tables, but change detection, which compares the last two deliveries. Searches ask with every row whose id is divisible by 50, or with
all evaluation questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.functions import regulatory as R
from statuta.functions.text import approx_tokens, squeezed
from statuta.operators import chunking, ordered, reports, retrieval, stats, store
from statuta.plans import api, questions
from statuta.plans.jobs import current
from statuta.plans.providers import overlap_score, sparse_weights
from statuta.runtime import cut, read, spread
from statuta.streaming import events as E

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


_SQ = r"trim(regexp_replace({0}, '[\s\x{{00a0}}]+', ' ', 'g'))"
_WORDS = f"list_filter(string_split({_SQ}, ' '), lambda w: w <> '')"
_TOKENS = f"greatest(1, floor(len({_WORDS}) * 1.35)::INT)"
_DOCS = "(SELECT * FROM documents WHERE text IS NOT NULL)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents"), "doc_id")


# Text and tokens


@query(f"SELECT doc_id, {_TOKENS.format('text')} AS n_tokens FROM {_DOCS}")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("text is not null").select("doc_id", approx_tokens(F.col("text")).alias("n_tokens"))


@query(f"SELECT count(*) AS n, round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS std, min(t) AS min, quantile_cont(t, 0.25) AS p25, quantile_cont(t, 0.5) AS p50, quantile_cont(t, 0.75) AS p75, max(t) AS max FROM (SELECT {_TOKENS.format('text')} AS t FROM {_DOCS})")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.describe(token_count(spark, d), "n_tokens").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"""WITH t AS (SELECT {_TOKENS.format('text')}::DOUBLE AS x FROM {_DOCS}), r AS (SELECT min(x) AS lo, max(x) AS hi FROM t)
SELECT least(49, floor((x - lo) / ((hi - lo) / 50))::INT) AS bin, count(*) AS n, round(min(lo) + bin * (min(hi) - min(lo)) / 50, 6) AS low, round(min(lo) + (bin + 1) * (min(hi) - min(lo)) / 50, 6) AS high FROM t, r GROUP BY bin""")
def token_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(token_count(spark, d), "n_tokens").withColumns({c: F.round(c, 6) for c in ("low", "high")})


_SENT = r"string_split(regexp_replace({0}, '([.!?])[\s\x{{00a0}}]+([A-Z(])', '\1' || chr(30) || '\2', 'g'), chr(30))"


@query(f"SELECT doc_id, pos - 1 AS pos, s AS sentence FROM (SELECT doc_id, unnest({_SENT.format('text')}) AS s, generate_subscripts({_SENT.format('text')}, 1) AS pos FROM {_DOCS})")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("text is not null").select("doc_id", F.posexplode(F.split("text", R.SENTENCE_END)).alias("pos", "sentence"))


_PARTS = f"""WITH RECURSIVE s AS (SELECT doc_id, text, {_SENT.format('text')} AS s, {_TOKENS.format('text')} AS total FROM {_DOCS}),
u AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM s WHERE total > 400),
k AS (SELECT doc_id, t, i, {_TOKENS.format('t')} AS n FROM u),
w AS (SELECT doc_id, t, i, n AS used, 1 AS part FROM k WHERE i = 1
  UNION ALL SELECT k.doc_id, k.t, k.i, CASE WHEN w.used + k.n > 400 THEN k.n ELSE w.used + k.n END, CASE WHEN w.used + k.n > 400 THEN w.part + 1 ELSE w.part END FROM w JOIN k ON k.doc_id = w.doc_id AND k.i = w.i + 1),
p AS (SELECT doc_id, part, string_agg(t, ' ' ORDER BY i) AS text, max(part) OVER (PARTITION BY doc_id) AS total_parts FROM w GROUP BY doc_id, part),
parts AS (SELECT doc_id, part, total_parts, CASE WHEN total_parts = 1 THEN (SELECT any_value(s.text) FROM s WHERE s.doc_id = p.doc_id) ELSE text END AS text FROM p UNION ALL SELECT doc_id, 1, 1, text FROM s WHERE total <= 400)
"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where("text is not null").select("doc_id", R.overflow_parts(F.col("text")).alias("parts"))
    return rows.select("doc_id", F.size("parts").alias("total_parts"), F.posexplode("parts").alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("part"), "total_parts", "text")


@query(_PARTS + "SELECT doc_id, max(total_parts) AS n_parts FROM parts GROUP BY doc_id")
def overflow_parts(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("text is not null").select("doc_id", F.size(R.overflow_parts(F.col("text"))).alias("n_parts"))


@query(_PARTS + "SELECT doc_id, part, total_parts, text, CASE WHEN part < total_parts THEN doc_id || '-part' || (part + 1) END AS next_chunk_id, CASE WHEN part > 1 THEN doc_id || '-part' || (part - 1) END AS prev_chunk_id FROM parts")
def overflow_chunks(spark: SparkSession, d: str) -> DataFrame:
    link = lambda n: F.concat(F.col("doc_id").cast("string"), F.lit("-part"), n.cast("string"))
    part, total = F.col("part"), F.col("total_parts")
    return _parts(spark, d).withColumns({"next_chunk_id": F.when(part < total, link(part + 1)), "prev_chunk_id": F.when(part > 1, link(part - 1))})


@query(_PARTS + "SELECT a.doc_id || '-part' || a.part AS chunk_id, b.part - a.part AS hop, b.doc_id || '-part' || b.part AS continuation FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND b.part > a.part AND b.part <= a.part + 5")
def chain_walk(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(overflow_chunks(spark, d).where("total_parts > 1"), "parts")  # read as hits and as parts
    name = F.concat(F.col("doc_id").cast("string"), F.lit("-part"), F.col("part").cast("string"))
    chunks = rows.select("doc_id", name.alias("chunk_id"), "text", F.struct("part", "total_parts", "next_chunk_id", "prev_chunk_id").alias("overflow_sequence"))
    hits = retrieval.expand_overflow(chunks.select(F.lit("all").alias("query_id"), "chunk_id"), chunks, chain="doc_id")
    return hits.select("chunk_id", F.posexplode("overflow_chunks").alias("at", "x")).select("chunk_id", (F.col("at") + 1).alias("hop"), F.col("x.chunk_id").alias("continuation"))


# The citation patterns of the format, as DuckDB writes them.
_CITES = [r"\d+[\s\x{00a0}]+U\.S\.C\.?[\s\x{00a0}]+[\d§\s\x{00a0}]+[\d][a-z]?(?:\([a-z0-9]+\))?", r"\d+[\s\x{00a0}]+CFR[\s\x{00a0}]+(?:parts?[\s\x{00a0}]+)?\d+(?:\.\d+)?", r"\d+[\s\x{00a0}]+FR[\s\x{00a0}]+\d+", r"E\.O\.[\s\x{00a0}]*\d+|Executive[\s\x{00a0}]+Order[\s\x{00a0}]+\d+"]


@query(
    "SELECT doc_id, list_sort(list_distinct(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(text, '(?i){p}')" for p in _CITES) + f"), lambda x: {_SQ.format('x')}))) AS citations, "
    + r"list_sort(list_distinct(regexp_extract_all(text, '(?i)§[\s\x{00a0}]*(\d{3,5}\.\d+(?:\([a-z0-9]+\))*)', 1))) AS internal FROM " + _DOCS
)
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("text is not null").select("doc_id", R.external_citations(F.col("text")).alias("citations"), R.internal_references(F.col("text")).alias("internal"))


@query(r"SELECT doc_id, lower(regexp_extract(file_name, '\.([^.]*)$', 1)) AS extension, text[1:300] AS head, length(text) > 12000 AS is_long FROM documents WHERE text IS NOT NULL AND file_name IS NOT NULL")
def upload_heads(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").where("text is not null and file_name is not null")
    return rows.select("doc_id", R.extension(F.col("file_name")).alias("extension"), R.first_chars(F.col("text"), 300).alias("head"), (F.length("text") > 12_000).alias("is_long"))


# Ids, hashes, headings


@query(r"SELECT doc_id, regexp_replace(sha256(text)[1:32], '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS point_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("text is not null").select("doc_id", R.point_id(F.col("text")).alias("point_id"), R.content_hash(F.col("text")).alias("content_hash"))


@query(r"""SELECT DISTINCT title_number, section_number, concat_ws('-', title_number, upper(regexp_replace(chapter_number, '[^A-Za-z0-9]', '', 'g')), replace(part_number, '.', '-'), coalesce(upper(subpart_letter), 'nosub'),
 trim(regexp_replace(section_number, '[^A-Za-z0-9]', '-', 'g'), '-'), 'sec') AS chunk_id FROM sections WHERE title_number IS NOT NULL AND chapter_number IS NOT NULL AND part_number IS NOT NULL AND section_number IS NOT NULL""")
def id_build(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "sections").dropna(subset=["title_number", "chapter_number", "part_number", "section_number"])
    c = F.col
    return rows.select("title_number", "section_number", R.chunk_id(c("title_number"), c("chapter_number"), F.lit(None), c("part_number"), c("subpart_letter"), c("section_number"), F.lit("sec")).alias("chunk_id")).distinct()


@query(r"SELECT DISTINCT section_name, trim(regexp_replace(lower(section_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM sections WHERE section_name IS NOT NULL UNION SELECT p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') FROM part")
def slug(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "sections").select("section_name").unionByName(read(spark, d, "part").select(F.col("p_name").alias("section_name")))
    return names.where("section_name is not null").distinct().select("section_name", R.slug(F.col("section_name")).alias("slug"))


_LEVELS = [("title", True), ("chapter", True), ("subchapter", False), ("part", True), ("subpart", False), ("section", True)]
_CRUMB = "concat_ws(' > ', " + ", ".join(
    f"CASE WHEN hierarchy.{n} IS NOT NULL THEN trim('{n.capitalize()} ' || {f'coalesce(hierarchy.{n}.number, $$$$)' if num else '$$$$'} || ': ' || coalesce(nullif(hierarchy.{n}.name, ''), {f'hierarchy.{n}.number, ' if num else ''}''), ': ') END" for n, num in _LEVELS
).replace("$$$$", "''") + ")"


@query(f"SELECT DISTINCT chunk_id, {_CRUMB} AS breadcrumb, sha256(concat_ws(' ', nullif({_CRUMB}, ''), nullif(section_preamble, ''), coalesce(text, ''))) AS content_hash FROM search_results WHERE hierarchy IS NOT NULL")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    h, pre, text = F.col("hierarchy"), F.col("section_preamble"), F.col("text")
    return read(spark, d, "search_results").where("hierarchy is not null").select("chunk_id", R.breadcrumb(h).alias("breadcrumb"), R.content_hash(R.embed_text(h, pre, text)).alias("content_hash")).distinct()


@query("SELECT DISTINCT chunk_id, hierarchy.title.number AS title_number, hierarchy.chapter.number AS chapter_number, hierarchy.part.number AS part_number, hierarchy.subpart.letter AS subpart_letter, hierarchy.section.number AS section_number, hierarchy.paragraph.label AS label FROM search_results")
def payload_flatten(spark: SparkSession, d: str) -> DataFrame:
    level = lambda n, k: F.col(f"hierarchy.{n}.{k}").alias(f"{n}_{k}")
    return read(spark, d, "search_results").select("chunk_id", level("title", "number"), level("chapter", "number"), level("part", "number"), level("subpart", "letter"), level("section", "number"), F.col("hierarchy.paragraph.label").alias("label")).distinct()


# Store


@query("SELECT count(*) AS n_keys, coalesce(sum(n - 1), 0)::BIGINT AS n_extra FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return store.duplicate_ids(read(spark, d, "documents").select(R.point_id(F.col("text")).alias("point_id")), "point_id")


_LAST = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY snapshot_no DESC, loaded_at DESC, text DESC NULLS LAST, cfr_citation DESC NULLS LAST) = 1"
_STATES = f"""WITH n AS (SELECT DISTINCT snapshot_no FROM chunk_snapshots ORDER BY 1 DESC LIMIT 2),
r AS (SELECT snapshot_no = (SELECT max(snapshot_no) FROM n) AS is_new, chunk_id, sha256(coalesce(text, '')) AS h FROM chunk_snapshots WHERE snapshot_no IN (SELECT snapshot_no FROM n) AND chunk_id IS NOT NULL {_LAST.format('snapshot_no, chunk_id')}),
src AS (SELECT chunk_id, h FROM r WHERE is_new), old AS (SELECT chunk_id, h FROM r WHERE NOT is_new)
"""


def _deliveries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The last delivery as source and the one before as store, by their numbers."""
    rows = read(spark, d, "chunk_snapshots")
    last, before = [r[0] for r in rows.select("snapshot_no").distinct().orderBy(F.desc("snapshot_no")).limit(2).collect()]
    hashed = lambda n: store.last_write(rows.where(F.col("snapshot_no") == n), "chunk_id", ["loaded_at", "text", "cfr_citation"]).select("chunk_id", R.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return hashed(last), hashed(before)


@query(_STATES + "SELECT src.chunk_id, CASE WHEN old.h = src.h THEN 'skip' ELSE 'upsert' END AS action FROM src LEFT JOIN old USING (chunk_id)")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    return store.changes(*_deliveries(spark, d), key="chunk_id").select("chunk_id", "action")


@query(_STATES + "SELECT chunk_id FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM src)")
def orphan_cleanup(spark: SparkSession, d: str) -> DataFrame:
    source, stored = _deliveries(spark, d)
    return store.orphans(stored, source, "chunk_id")


@query(_STATES + """SELECT (SELECT count(*) FROM src) AS n_source, (SELECT count(*) FROM src JOIN old USING (chunk_id, h)) AS n_skipped, (SELECT count(*) FROM src) - (SELECT count(*) FROM src JOIN old USING (chunk_id, h)) AS n_upserted, (SELECT count(*) FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM src)) AS n_orphans""")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    source, stored = _deliveries(spark, d)
    marked = store.changes(source, stored, key="chunk_id").select("action").unionByName(store.orphans(stored, source, "chunk_id").select(F.lit("orphan").alias("action")))
    n = lambda *kinds: F.count_if(F.col("action").isin(*kinds))
    return marked.agg(n("skip", "upsert").alias("n_source"), n("skip").alias("n_skipped"), n("upsert").alias("n_upserted"), n("orphan").alias("n_orphans"))


@query(f"SELECT chunk_id, snapshot_no, sha256(coalesce(text, '')) AS content_hash FROM chunk_snapshots WHERE chunk_id IS NOT NULL {_LAST.format('chunk_id')}")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = store.last_write(read(spark, d, "chunk_snapshots"), "chunk_id", ["snapshot_no", "loaded_at", "text", "cfr_citation"])
    return rows.select("chunk_id", "snapshot_no", R.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


# Retrieval

_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"
_TOP = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {0}"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s9 DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score, score AS s9 FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) QUALIFY rank <= 60")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.dense_search(read(spark, d, "embeddings"), _asked(spark, d), 60, "vec_id", "embedding"))


@query(f"SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s9 DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score, score AS s9 FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.label = 3) QUALIFY rank <= 60")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.dense_search(read(spark, d, "embeddings").where("label = 3"), _asked(spark, d), 60, "vec_id", "embedding"))


_KNN = f"knn AS (SELECT a.vec_id AS query_id, a.label AS query_label, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 5)"


def _knn(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_search(read(spark, d, "embeddings"), _asked(spark, d), 5, "vec_id", "embedding")


@query(f"WITH {_KNN} SELECT query_id, id, round(score, 6) AS score, rank FROM knn")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_knn(spark, d))


@query(f"WITH {_KNN} SELECT query_label, id, query_id, rank FROM knn QUALIFY row_number() OVER (PARTITION BY query_label, id ORDER BY query_id, rank) = 1")
def union_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    hits = _knn(spark, d).join(_asked(spark, d).select("query_id", "query_label"), "query_id")
    return retrieval.keep_first(hits, ["query_label", "id"], ["query_id", "rank"]).select("query_label", "id", "query_id", "rank")


_TERM = r"SELECT {0} AS id, unnest(list_filter(string_split_regex(lower({1}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS term FROM {2} WHERE {1} IS NOT NULL"
_SPARSE = f"""dt AS (SELECT id, term, count(*) AS w FROM ({_TERM.format('doc_id', 'text', 'documents')}) GROUP BY ALL), qt AS (SELECT id, term, count(*) AS w FROM ({_TERM.format('item_id', 'question', 'eval_items')}) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, t.id, sum(q.w * t.w)::DOUBLE AS score FROM dt t JOIN qt q USING (term) GROUP BY ALL) QUALIFY rank <= 60)"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    return items.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    asked = retrieval.terms(_questions(spark, d), "query_id", "query").withColumnRenamed("id", "query_id")
    return retrieval.sparse_search(retrieval.terms(_documents(spark, d), "doc_id"), asked)


@query(f"WITH {_SPARSE} SELECT query_id, id, score, rank FROM sparse")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_sparse(spark, d))


_DENSE = """dense AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) AS rank FROM embeddings a JOIN eval_items i ON i.item_id = a.vec_id, embeddings b {0} QUALIFY rank <= 60)"""
_RRF = """f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id, d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS rrf
  FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.id = s.id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST) AS fused_rank FROM f QUALIFY fused_rank <= 20)"""


@query(f"WITH {_SPARSE}, {_DENSE.format('')}, {_RRF} SELECT query_id, id, round(rrf, 9) AS rrf_score, fused_rank FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    dense = retrieval.dense_search(read(spark, d, "embeddings"), _questions(spark, d), 60, "vec_id", "embedding")
    return retrieval.fuse(dense, _sparse(spark, d)).select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"), "fused_rank")


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the vector of the same number, where there is one."""
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"))
    rows = _documents(spark, d).join(vectors, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("point_id"), "text", "dense", F.col("source").alias("chunk_type"), F.col("file_name").alias("source_file"))


_KNOWN = "JOIN documents x ON x.doc_id = b.vec_id"


@query(f"WITH {_SPARSE}, {_DENSE.format(_KNOWN)}, {_RRF} SELECT query_id, fused.id, round(rrf, 9) AS rrf_score, fused_rank AS rank, source AS chunk_type, text[1:200] AS head FROM fused JOIN documents ON doc_id = fused.id WHERE fused_rank <= 10")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.search(_points(spark, d), _questions(spark, d), top_k=10)
    return hits.select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"), "rank", "chunk_type", R.first_chars(F.col("text"), 200).alias("head"))


_SETS = "list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: t <> ''))"


@query(f"""WITH {_SPARSE}, {_DENSE.format(_KNOWN)}, {_RRF},
s AS (SELECT query_id, fused.id, fused_rank, len(list_intersect({_SETS.format('question')}, {_SETS.format('text')}))::DOUBLE / greatest(1, len({_SETS.format('question')})) AS share FROM fused JOIN documents ON doc_id = fused.id JOIN eval_items ON item_id = query_id),
t AS (SELECT *, 1 / (1 + exp(-(share * 4 - CASE WHEN share > 0 THEN 2 ELSE 0 END))) AS score FROM s)
SELECT query_id, id, round(score, 6) AS reranker_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM t QUALIFY rank <= 10""")
def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.search(_points(spark, d), _questions(spark, d), top_k=100, use_reranker=True, scorer=overlap_score)
    return hits.select("query_id", "id", F.round("reranker_score", 6).alias("reranker_score"), "rank")


_NUMBER = r"regexp_extract({0}, '(\d+\.\d+[a-z]?)', 1)"


@query(f"""WITH c AS (SELECT chunk_id, max(metadata.section_number) AS section, max(score) AS score FROM search_results GROUP BY 1),
h AS (SELECT DISTINCT query_id, chunk_id FROM search_results WHERE query_id IS NOT NULL),
r AS (SELECT DISTINCT query_id, {_NUMBER.format('x')} AS section FROM (SELECT query_id, unnest(metadata.cross_references_internal) AS x FROM search_results WHERE query_id IS NOT NULL) WHERE x IS NOT NULL),
b AS (SELECT r.query_id, c.chunk_id, section, row_number() OVER (PARTITION BY r.query_id, section ORDER BY c.score DESC, c.chunk_id) AS n FROM r JOIN c USING (section) WHERE score IS NOT NULL QUALIFY n <= 3)
SELECT query_id, chunk_id, min(section) AS section FROM b WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM h) GROUP BY ALL""")
def xref_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "search_results")
    number = lambda c: F.regexp_extract(c, r"(\d+\.\d+[a-z]?)", 1)
    chunks = rows.groupBy("chunk_id").agg(F.max("metadata.section_number").alias("section_number"), F.max("score").alias("score"))
    refs = F.transform("metadata.cross_references_internal", number)
    retrieved = rows.where("query_id is not null").select("query_id", "chunk_id", F.filter(refs, lambda x: x.isNotNull()).alias("cross_references_internal"))
    return retrieval.cross_references(retrieved, chunks, chunks.where("score is not null").select("chunk_id", "score"))


_HITS = "SELECT query_id, chunk_id, defines, max(score) AS score FROM search_results WHERE chunk_type = 'definition' AND defines IS NOT NULL AND query_id IS NOT NULL GROUP BY ALL"


@query(f"""WITH g AS ({_HITS}), t AS (SELECT DISTINCT query_id, lower(defines) AS term FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM g)
SELECT query_id, term, chunk_id, lower(defines) = term AS exact_match FROM r JOIN t USING (query_id) WHERE rank <= 3 QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY lower(defines) = term DESC, rank) = 1""")
def definition_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every term that any hit of a query defines, looked up among the query's first hits."""
    rows = read(spark, d, "search_results").where("chunk_type = 'definition' and defines is not null and query_id is not null").groupBy("query_id", "chunk_id", "defines").agg(F.max("score").alias("score"))
    wanted = rows.select("query_id", F.lower("defines").alias("term")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")
    hits = rows.withColumn("rank", F.row_number().over(order)).join(wanted, "query_id")
    return retrieval.definitions(hits).select("query_id", "term", "chunk_id", "exact_match")


@query(f"WITH g AS ({_HITS}), t AS (SELECT query_id, lower(defines) AS term, max(chunk_id) AS last FROM g GROUP BY 1, 2) SELECT query_id, count(*) AS n_terms, string_agg(term || '=' || last, ';' ORDER BY term) AS definitions FROM t GROUP BY 1")
def definition_map(spark: SparkSession, d: str) -> DataFrame:
    """The map of a query's terms; of several definitions of a term the last by chunk_id stays."""
    rows = read(spark, d, "search_results").where("chunk_type = 'definition' and defines is not null").select("query_id", F.lower("defines").alias("term"), "chunk_id", F.col("chunk_id").alias("text"))
    entries = F.map_entries("definitions")
    return retrieval.last_definitions(rows, ["chunk_id"]).select("query_id", F.size("definitions").cast("long").alias("n_terms"), F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("definitions"))


_RESULT = "SELECT DISTINCT query_id, chunk_id, coalesce(text, '') AS text, coalesce(cfr_citation, '') AS cfr_citation, coalesce(chunk_type, '') AS chunk_type, section_preamble, defines, coalesce(reranker_score, score, 0.0) AS score, metadata.part_number AS part_number, metadata.section_number AS section_number FROM search_results"


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Search results as hits of a search, with the columns that ``results`` reads."""
    rows = read(spark, d, "search_results").withColumn("rank", F.lit(1))
    return retrieval.results(rows.select("*", "metadata.part_number", "metadata.section_number", "metadata.source_file", "metadata.cross_references_internal").withColumn("rrf_score", F.col("score")).drop("metadata"))


@query(_RESULT)
def result_projection(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.compact(_results(spark, d)).drop("rank").distinct()


@query("SELECT query_id, count(*) AS total_results, min(chunk_id) AS first_chunk, coalesce(max(len(metadata.cross_references_internal)), 0) AS most_references FROM search_results GROUP BY 1")
def search_responses(spark: SparkSession, d: str) -> DataFrame:
    found = api.responses(_results(spark, d))
    most = F.array_max(F.transform("results", lambda r: F.when(F.size(r["metadata"]["cross_references_internal"]) > 0, F.size(r["metadata"]["cross_references_internal"])))).cast("long")
    return found.select("query_id", "total_results", F.array_min(F.transform("results", lambda r: r["chunk_id"])).alias("first_chunk"), F.coalesce(most, F.lit(0)).alias("most_references"))


@query(r"SELECT DISTINCT chunk_id, array_to_string(list_filter(list_concat([text], list_transform(coalesce(overflow_chunks, []), lambda x: x.text)), lambda t: t <> ''), ' ') AS whole FROM search_results")
def overflow_concat(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "search_results").select("chunk_id", R.whole_text(F.col("text"), F.col("overflow_chunks")).alias("whole")).distinct()


_FILTERED = """SELECT i.item_id AS query_id, i.question, CASE WHEN d.source IN ('rule', 'guidance') OR d.lang = 'en' THEN d.source END AS kind FROM eval_items i LEFT JOIN documents d ON d.doc_id = i.item_id"""


@query(f"""WITH q AS ({_FILTERED}), dt AS (SELECT id, source, term, count(*) AS w FROM (SELECT doc_id AS id, source, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
qt AS (SELECT id, kind, term, count(*) AS w FROM (SELECT query_id AS id, kind, unnest(list_filter(string_split_regex(lower(question), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM q WHERE question IS NOT NULL) GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, t.id, sum(q.w * t.w)::DOUBLE AS score FROM dt t JOIN qt q ON q.term = t.term AND (q.kind IS NULL OR q.kind = t.source) GROUP BY ALL) QUALIFY rank <= 60""")
def filtered_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every question over the documents that its own filter leaves; a null filter leaves all."""
    documents = _documents(spark, d)
    kinds = documents.select(F.col("doc_id").alias("query_id"), F.when(F.col("source").isin("rule", "guidance") | (F.col("lang") == "en"), F.col("source")).alias("kind"))
    asked = read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query")).join(kinds, "query_id", "left")
    filters = {"source": "kind"}
    asked = asked.withColumn("scope", retrieval.scope_of(filters))
    kept = retrieval.in_scopes(documents.select("doc_id", "text", "source"), asked, filters)
    words = retrieval.terms(asked, "query_id", "query", also=["scope"]).withColumnRenamed("id", "query_id")
    return _shown(retrieval.sparse_search(retrieval.terms(kept, "doc_id", also=["scope"]), words, scope=["scope"]))


@query("SELECT item_id, CASE WHEN coalesce(length(question), 0) < 5 THEN 'a question has at least 5 characters' END AS error FROM (SELECT item_id, question[1:item_id % 12] AS question FROM eval_items)")
def question_checks(spark: SparkSession, d: str) -> DataFrame:
    """Heads of the questions, of 0 to 11 characters, checked as ``ask`` does."""
    rows = read(spark, d, "eval_items").select("item_id", F.substring("question", F.lit(1), (F.col("item_id") % 12).cast("int")).alias("query"))
    return questions.checked_questions(rows).select("item_id", "error")


# Windows and ordered aggregates

_LABELS = ["(a)", "(1)", "(ii)", "(A)", "(c)", "(b)", "(2)", "(i)", None]
_PLACE = [1, 2, 3, 4, 1, 1, 2, 1, None]
_ROWS = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, (l_partkey * 7 + l_linenumber * 13 + l_suppkey) % 9 AS k FROM lineitem)"
_LIST = lambda v: "[" + ", ".join("NULL" if x is None else repr(x) for x in v) + "]"
_W = "OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH r AS (SELECT l_orderkey, pos, {_LIST(_PLACE)}[k + 1] AS raw, {_LIST(_LABELS)}[k + 1] AS label FROM {_ROWS}),
e AS (SELECT *, raw = 1 AND label IN ('(i)', '(c)') AS amb, coalesce(last_value(CASE WHEN raw = 2 THEN true WHEN raw = 1 AND label NOT IN ('(i)', '(c)') THEN false END IGNORE NULLS) {_W}, false) AS num FROM r),
l AS (SELECT l_orderkey, pos, label, CASE WHEN amb AND num THEN 3 ELSE raw END AS level FROM e),
a AS (SELECT *, {', '.join(f"last_value(CASE WHEN level <= {i} THEN {{'level': level, 'label': label}} END IGNORE NULLS) {_W} AS a{i}" for i in (1, 2, 3))} FROM l)
SELECT l_orderkey, pos, level, CASE WHEN label IS NOT NULL THEN concat({', '.join(f"CASE WHEN level > {i} AND a{i}.level = {i} THEN a{i}.label ELSE '' END" for i in (1, 2, 3))}, label) END AS label_path FROM a""")
def label_path(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k = ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_suppkey")) % 9).cast("int")
    raw = F.array(*[F.lit(None).cast("struct<level:int,label:string>") if label is None else F.struct(F.lit(place).alias("level"), F.lit(label).alias("label")) for place, label in zip(_PLACE, _LABELS)])
    rows = read(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("pos"), F.get(raw, k).alias("raw"))
    return chunking.label_paths(rows, ["l_orderkey"], "pos").select("l_orderkey", "pos", "level", "label_path")


_LINES = "(SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_returnflag || l_linestatus AS kind FROM lineitem)"
_SOFAR = "OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order in sequence: an order has a few, as a section has, so its window is bounded."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(order).alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("kind"))


@query(f"SELECT k, pos, first_value(CASE WHEN kind = 'NO' THEN pos END IGNORE NULLS) {_SOFAR} AS first_open FROM {_LINES}")
def preamble_ffill(spark: SparkSession, d: str) -> DataFrame:
    return ordered.first_so_far(_lines(spark, d), ["k"], ["pos"], F.when(F.col("kind") == "NO", F.col("pos")), "first_open").drop("kind")


@query(f"SELECT k, island, count(*) AS n, min(pos) AS since FROM (SELECT k, pos, sum(CASE WHEN kind = 'NO' THEN 1 ELSE 0 END) {_SOFAR}::BIGINT AS island FROM {_LINES}) GROUP BY ALL")
def fold_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.islands(_lines(spark, d), ["k"], ["pos"], F.col("kind") == "NO")
    return rows.groupBy("k", "island").agg(F.count("*").alias("n"), F.min("pos").alias("since"))


@query("SELECT l_orderkey, l_suppkey, l_linenumber, count(*) OVER w AS n_same, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS occ FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_suppkey)")
def occurrence_index(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.occurrences(read(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_extendedprice"])
    return rows.select("l_orderkey", "l_suppkey", "l_linenumber", "n_same", "occ")


@query(f"SELECT k, pos, lag(kind) OVER w AS prev_kind, lead(kind) OVER w AS next_kind FROM {_LINES} WINDOW w AS (PARTITION BY k ORDER BY pos)")
def neighbour_links(spark: SparkSession, d: str) -> DataFrame:
    return ordered.neighbours(_lines(spark, d), ["k"], ["pos"], "kind").drop("kind")


@query(f"SELECT k, string_agg(kind, ' ' ORDER BY pos) AS path FROM {_LINES} GROUP BY k")
def string_agg_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("k").agg(ordered.joined(F.col("kind"), F.col("pos")).alias("path"))


@query(f"SELECT k, list(kind ORDER BY f) AS kinds FROM (SELECT k, kind, min(pos) AS f FROM {_LINES} GROUP BY ALL) GROUP BY k")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("k").agg(ordered.distinct_in_order(F.col("kind"), F.col("pos")).alias("kinds"))


_HIT = r"""h AS (SELECT query_id, chunk_id, max(text) AS text, max(score) AS score, max(section_preamble) AS preamble, max(array_to_string(list_transform(overflow_chunks, lambda x: x.text), ' ')) AS more FROM search_results WHERE query_id IS NOT NULL GROUP BY ALL),
g AS (SELECT *, (SELECT cfr_citation FROM search_results s WHERE s.query_id = h.query_id AND s.chunk_id IS NOT DISTINCT FROM h.chunk_id ORDER BY s.result_id LIMIT 1) AS cite FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM g)"""


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Hits of every query as retrieved rows: a row per chunk, ranked by score."""
    rows = read(spark, d, "search_results").where("query_id is not null")
    parts = F.max("overflow_chunks").alias("overflow_chunks")
    hits = rows.groupBy("query_id", "chunk_id").agg(F.min_by("cfr_citation", "result_id").alias("cfr_citation"), F.max("text").alias("text"), F.max("score").alias("score"), F.max("section_preamble").alias("section_preamble"), parts)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")
    return hits.withColumns({"rank": F.row_number().over(order), "sq": F.lit(0)})


@query(rf"""WITH {_HIT},
t AS (SELECT *, trim(concat_ws(' ', preamble, text, coalesce(more, '')), ' ') AS whole FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM t WHERE whole <> '' QUALIFY i <= 8),
a AS (SELECT query_id, string_agg('[' || i || '] ' || coalesce(cite, 'Unknown section') || chr(10) || whole[1:800], chr(10) ORDER BY i) AS context FROM n GROUP BY 1),
f AS (SELECT query_id, coalesce(cite, 'Unknown section') AS cite, min(rank) AS first FROM r GROUP BY ALL)
SELECT query_id, coalesce(context, '') AS context, list(cite ORDER BY first) AS retrieved_sections FROM f LEFT JOIN a USING (query_id) GROUP BY ALL""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return questions.context(_retrieved(spark, d))


@query(rf"""WITH {_HIT} SELECT query_id, string_agg('[' || coalesce(cite, '') || '] ' || coalesce(text, '')[1:600], chr(10) || '---' || chr(10) ORDER BY rank) AS evidence FROM r WHERE rank <= 10 GROUP BY 1""")
def evidence_pack(spark: SparkSession, d: str) -> DataFrame:
    found = _retrieved(spark, d)
    return questions.evidence(found, found.limit(0).withColumn("section", F.lit("")))


# Reports, events, JSON

_SEV = {"RF": "critical", "AF": "high", "NO": "medium", "NF": "low"}
_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEV.items()) + " ELSE 'other' END"
_COUNTS = ", ".join(f"count(*) FILTER (s = '{s}') AS {s}" for s in reports.SEVERITIES)
_FOUND = f"(SELECT k, pos, kind, {_CASE} AS s FROM {_LINES})"
_PLACES = "CASE s " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(reports.SEVERITIES)) + f" ELSE {len(reports.SEVERITIES)} END"
_REPORT = f"(SELECT o_orderkey AS document_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'unreadable' END AS error, coalesce(total, 0) AS total, " + ", ".join(f"coalesce({s}, 0) AS {s}" for s in reports.SEVERITIES) + f", findings FROM orders LEFT JOIN (SELECT k, count(*) AS total, {_COUNTS}, string_agg(s || '@' || pos, ' ' ORDER BY {_PLACES}, pos) AS findings FROM {_FOUND} GROUP BY 1) ON k = o_orderkey)"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select(F.col("k").alias("document_id"), F.col("pos").alias("seq"), reports.mapped(F.col("kind"), _SEV, "other").alias("severity"), F.col("kind").alias("text"))


@query(f"SELECT *, CASE WHEN error IS NOT NULL AND total = 0 THEN 'error' WHEN critical + high > 0 THEN 'non_compliant' WHEN medium + low > 0 THEN 'partially_compliant' ELSE 'compliant' END AS overall_status, CASE overall_status WHEN 'compliant' THEN 'compliant' WHEN 'non_compliant' THEN 'non_compliant' ELSE 'needs_review' END AS shown FROM {_REPORT}")
def severity_report(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, some with an error; lines as findings, listed by severity."""
    documents = read(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "unreadable").alias("error"))
    found = reports.severity_report(documents, _findings(spark, d))
    lines = F.array_join(F.transform("findings", lambda x: F.concat_ws("@", x["severity"], x["seq"].cast("string"))), " ")
    return found.withColumns({"findings": lines, "shown": reports.shown_status(F.col("overall_status"))})


@query(f"SELECT k AS document_id, 'v-' || pos AS id, CASE kind WHEN 'RF' THEN 'critical' WHEN 'AF' THEN 'warning' WHEN 'NO' THEN 'info' WHEN 'NF' THEN 'pass' ELSE 'info' END AS severity, CASE kind WHEN 'RF' THEN 'Prohibited' ELSE 'Potential Violation' END || ' Health Claim' AS title, 'Health Claim' AS category, CASE kind WHEN 'RF' THEN '{reports.ADVICE['prohibited']}' ELSE '{reports.OTHER_ADVICE}' END AS recommendation, '{reports.DEFAULT_REGULATION}' AS regulation FROM {_LINES}")
def findings_view(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("text") == "RF", "prohibited")
    rows = _findings(spark, d).withColumns({"violation_type": kind, "claim_type": F.lit("health_claim"), "claim_text": F.col("text"), "explanation": F.lit(""), "cfr_citation": F.lit(None).cast("string")})
    return reports.finding_view(rows).select("document_id", "id", "severity", "title", "category", "recommendation", "regulation")


@query("SELECT document_id, 'Found ' || total || ' potential issue' || CASE WHEN total > 1 THEN 's' ELSE '' END || ' in ' || document_id || ': ' || concat_ws(', ', CASE WHEN critical > 0 THEN critical || ' critical' END, CASE WHEN high > 0 THEN high || ' high-priority' END, CASE WHEN medium > 0 THEN medium || ' medium' END, CASE WHEN low > 0 THEN low || ' low' END) || '.' AS summary FROM " + _REPORT + " WHERE total > 0 UNION ALL SELECT document_id, 'No violations detected in ' || document_id || '.' FROM " + _REPORT + " WHERE total = 0")
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    return severity_report(spark, d).select("document_id", reports.summary_line(F.col("document_id").cast("string")).alias("summary"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_state, max(ts) AS last_ts FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def job_last_status(spark: SparkSession, d: str) -> DataFrame:
    return E.last_states(read(spark, d, "events"))


@query("SELECT from_state, event_type AS to_state, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events) WHERE from_state IS NOT NULL GROUP BY ALL")
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    return E.transitions(read(spark, d, "events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
  FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(read(spark, d, "events"))


# Strings, lists and sparse vectors


_CSV = "concat_ws(',', source, ' https://example.org/' || lang || '// ', file_name, '', source, docket_id || '/')"


@query(f"SELECT doc_id, list_filter(p, lambda x, i: x <> '' AND list_position(p, x) = i) AS items FROM (SELECT doc_id, list_transform(string_split({_CSV}, ','), lambda x: rtrim(trim(x), '/')) AS p FROM documents)")
def csv_items(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(",", "source", F.concat(F.lit(" https://example.org/"), "lang", F.lit("// ")), "file_name", F.lit(""), "source", F.concat("docket_id", F.lit("/")))
    return read(spark, d, "documents").select("doc_id", R.csv_items(text).alias("items"))


@query("SELECT doc_id, CASE WHEN starts_with(file_name, source || '/') THEN file_name ELSE 'local/' || file_name END AS model FROM (SELECT doc_id, 'local' AS source, CASE WHEN doc_id % 2 = 0 THEN 'local/' || file_name ELSE file_name END AS file_name FROM documents)")
def prefixed_names(spark: SparkSession, d: str) -> DataFrame:
    """File names, every other one with the prefix already."""
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("local/"), "file_name")).otherwise(F.col("file_name"))
    return read(spark, d, "documents").select("doc_id", R.prefixed(name, "local").alias("model"))


_PLACE_OF = "('0x' || md5(term)[1:7])::INT"


@query(f"WITH t AS (SELECT id, {_PLACE_OF} AS place, max(w) AS w FROM (SELECT id, term, count(*)::DOUBLE AS w FROM ({_TERM.format('doc_id', 'text', 'documents')}) GROUP BY ALL) GROUP BY ALL) SELECT id AS doc_id, list(place ORDER BY place) AS indices, list(w ORDER BY place) AS weights FROM t GROUP BY 1")
def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The sparse vector of every document with words, as two lists in order of the places."""
    rows = sparse_weights(_documents(spark, d), "doc_id", "text").select("doc_id", R.sparse_arrays(F.col("sparse")).alias("v"))
    return rows.select("doc_id", F.col("v.indices").alias("indices"), F.col("v.values").alias("weights"))


@query("SELECT file_id, CASE WHEN json_valid(payload) AND json_type(payload) = 'ARRAY' THEN json_array_length(payload)::INT ELSE 0 END AS n FROM chunk_files")
def json_list_guard(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunk_files").select("file_id", F.size(R.json_list(F.col("payload"))).alias("n"))


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"source":' || coalesce(to_json(source)::VARCHAR, 'null') || ',"docket_id":' || coalesce(to_json(docket_id)::VARCHAR, 'null') || '}' AS json FROM documents""")
def json_serialise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "source", "docket_id"), {"ignoreNullFields": "false"}).alias("json"))


_LINE_OF = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"
_LEAD = r"^[\s\x{00a0}]*\([\s\x{00a0}]*"
_END = r"[\s\x{00a0}]*\)[\s\x{00a0}]"


@query(rf"""WITH l AS (SELECT doc_id, pos, regexp_extract(line, '{_LEAD}(\d+){_END}', 1) AS n, regexp_extract(line, '(?i){_LEAD}([ivxlcdm]{{1,8}}){_END}', 1) AS r, regexp_extract(line, '{_LEAD}([A-Z]){_END}', 1) AS c, regexp_extract(line, '{_LEAD}([a-z]){_END}', 1) AS a FROM {_LINE_OF})
SELECT doc_id, pos, CASE WHEN n <> '' THEN 2 WHEN length(r) > 1 THEN 3 WHEN c <> '' THEN 4 ELSE 1 END AS level, '(' || CASE WHEN n <> '' THEN n WHEN length(r) > 1 THEN lower(r) WHEN c <> '' THEN c ELSE a END || ')' AS label FROM l WHERE n <> '' OR length(r) > 1 OR c <> '' OR a <> ''""")
def label_detect(spark: SparkSession, d: str) -> DataFrame:
    """Labels that lines of the documents start with, before their context is known."""
    lines = _documents(spark, d).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "pos", R.raw_label(F.col("line")).alias("x")).where("x is not null").select("doc_id", "pos", "x.level", "x.label")


# Jobs and states


@query("SELECT user_id::VARCHAR AS job_id, max(event_id)::INT AS seq, arg_max(event_type, event_id) AS status, arg_max(ts, event_id) AS at FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def job_current(spark: SparkSession, d: str) -> DataFrame:
    """Events as state changes of jobs, one a user: the present state of each."""
    none = F.lit(None).cast("string")
    changes = read(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").cast("int").alias("seq"), F.col("event_type").alias("status"), none.alias("result"), none.alias("error"), F.col("ts").alias("at"))
    return current(changes).drop("result", "error")


_LABEL = "CASE WHEN s IN ('running', 'no_run') THEN s WHEN ok THEN 'ready' WHEN NOT ok THEN 'error' ELSE 'unknown' END"


@query(f"""SELECT o_orderkey, label, CASE label WHEN 'ready' THEN 'Data ready' WHEN 'running' THEN 'Indexing…' WHEN 'error' THEN 'Index error' WHEN 'no_run' THEN 'Not indexed' ELSE '' END AS shown, CASE WHEN ok THEN 'Verified' ELSE 'Unverified' END || ', ' || n || ' citation' || CASE WHEN n = 1 THEN '' ELSE 's' END AS badge
FROM (SELECT *, {_LABEL} AS label FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'no_run' END AS s, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority = '1-URGENT' END AS ok, (o_orderkey % 4)::INT AS n FROM orders))""")
def status_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of run states; orders stand for the runs."""
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "no_run")
    success = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority") == "1-URGENT")
    label = api.status_label(status, success)
    return read(spark, d, "orders").select("o_orderkey", label.alias("label"), api.index_label(label).alias("shown"), api.answer_badge(success, (F.col("o_orderkey") % 4).cast("int")).alias("badge"))
