"""Batch retrieval: pre-filtered dense and sparse search, rank fusion, rerank, expansion.

Everything works on a batch of queries keyed by query_id, so many questions cost one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statuta.functions.text import words
from statuta.runtime import cut, small

#: Stated defaults of a search.
DENSE_TOP, SPARSE_TOP, FUSED_TOP, RERANK_TOP, RRF_K, MOST_HOPS = 60, 60, 20, 10, 60, 5
FILTERS = ("part_number", "chapter_number", "subpart_letter", "section_number", "chunk_type", "source_file")
#: Queries are broadcast in blocks of so many, or of so many rows of terms (64 MB); each block of a larger batch
#: is one pass over the points.
MOST_BROADCAST_QUERIES, MOST_BROADCAST_TERMS = 20_000, 4_000_000
#: Scores that a task holds at once: rows of a batch times queries.
MOST_SCORES = 4_000_000


def predicate(filters: dict[str, str | None]) -> Column:
    """Conjunction of equalities of the filters that are given; true if none is."""
    unknown = set(filters) - set(FILTERS)
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    found = F.lit(True)
    for name, value in filters.items():
        if value is not None:
            found = found & (F.col(name) == value)
    return found


def ranked(scored: DataFrame, key: list[str], score: str, tie: list[str], k: int) -> DataFrame:
    """The k rows with the largest score per key, with ``rank`` from 1; ties by ``tie``."""
    order = Window.partitionBy(*key).orderBy(F.desc(score), *tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scope_of(filters: dict[str, str]) -> Column:
    """The key of what a query's filters admit: ``filters`` has the filter of each column that holds a value or null."""
    return F.concat_ws("\u0001", *[F.concat(F.lit(f"{name}="), F.col(value)) for name, value in filters.items()])


def in_scopes(points: DataFrame, queries: DataFrame, filters: dict[str, str]) -> DataFrame:
    """``points`` with ``scope``: a row for each scope of ``queries`` that a point lies in.

    ``filters`` names for each column of the points the column of the queries that restricts it, where
    null restricts nothing. There are as many kinds of scope as combinations of columns, so each
    kind is one equality of keys.
    """
    kinds = queries.select(*[F.col(c).isNotNull().alias(n) for n, c in filters.items()]).distinct().collect()
    parts = lambda kind: [F.concat(F.lit(f"{n}="), F.col(n)) for n in filters if kind[n]]
    between = lambda cs: F.concat(*[x for c in cs for x in (F.lit("\u0001"), c)][1:]) if cs else F.lit("")
    keys = F.array(*[between(parts(kind)) for kind in kinds]) if kinds else F.array(F.lit(""))
    return points.withColumn("scope", F.explode(keys)).join(queries.select("scope").distinct(), "scope", "left_semi")


class _Best:
    """The k best ids of every query over all batches of a task; of equal scores the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.at, self.value, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), None

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        """Scores of a row per id and a column per query; minus infinity is no hit."""
        least = self.least
        if len(ids) > self.k and not np.isfinite(least).all():
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, query = np.nonzero((scores >= least) & (scores > -np.inf))
        if not len(row):
            return
        ids = ids.take(pa.array(np.unique(row, return_inverse=True)[0]))
        pool = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        at = np.r_[self.at, np.unique(row, return_inverse=True)[1] + (len(pool) - len(ids))]
        query, value = np.r_[self.query, query], np.r_[self.value, scores[row, query]]
        place = np.empty(len(pool), np.int64)
        place[pc.sort_indices(pool).to_numpy()] = np.arange(len(pool))
        order = np.lexsort((place[at], -value, query))
        at, query, value = at[order], query[order], value[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        kept = rank < self.k
        self.least[query[rank == self.k - 1]] = value[rank == self.k - 1]
        used, self.at = np.unique(at[kept], return_inverse=True)
        self.ids, self.query, self.value = pool.take(pa.array(used)), query[kept], value[kept]

    def batch(self, names: list) -> pa.RecordBatch | None:
        if self.ids is None:
            return None
        return pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(self.query)), self.ids.take(pa.array(self.at)), pa.array(self.value)], ["query_id", "id", "score"])


def _blocks(asked: DataFrame, most_rows: int) -> Iterator[list[Row]]:
    """The rows of the queries in bounded blocks, a query's rows together; one block if they are few."""
    if asked.limit(most_rows + 1).count() <= min(most_rows, MOST_BROADCAST_QUERIES):
        yield asked.collect()
        return
    block, names, last = [], 0, object()
    for row in asked.orderBy("query_id").toLocalIterator():
        if row["query_id"] != last:
            if block and (names >= MOST_BROADCAST_QUERIES or len(block) >= most_rows):
                yield block
                block, names = [], 0
            names, last = names + 1, row["query_id"]
        block.append(row)
    if block:
        yield block


def _in_blocks(asked: DataFrame, most_rows: int, k: int, search: Callable[[list[Row]], DataFrame]) -> DataFrame:
    """The k best per query; every block is a pass over the points, the same whatever the blocks are."""
    scored = None
    for n, block in enumerate(_blocks(asked, most_rows)):
        if n:
            scored = cut(ranked(scored, ["query_id"], "score", ["id"], k).drop("rank"), "block") if n == 1 else scored
            part = cut(ranked(search(block), ["query_id"], "score", ["id"], k).drop("rank"), "block")
        else:
            part = search(block)
        scored = part if scored is None else scored.unionByName(part)
    return ranked(scored, ["query_id"], "score", ["id"], k)


def dense_search(points: DataFrame, queries: DataFrame, k: int = DENSE_TOP, id_column: str = "point_id", vector: str = "dense", scope: list[str] | None = None) -> DataFrame:
    """(query_id, id, score, rank): exact cosine of every query with every point.

    Filter ``points`` before the call, or name columns of both as ``scope`` if every query has its own
    filter: then only points with the query's scope (``in_scopes``) are ranked. The query set is stated and checked before it is broadcast;
    each task hands on its k best per query. Null vectors, vectors of another length,
    not finite ones and zero vectors are left out. Scores are rounded to 9 decimals, ties go to the
    smaller id.
    """
    asked = queries.where(F.col("query_id").isNotNull() & F.col("vector").isNotNull())
    known, scope = points.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()), scope or []
    known, asked = known.select(F.col(id_column).alias("id"), F.col(vector).alias("v"), *scope), asked.select("query_id", "vector", *scope)
    return _in_blocks(asked, MOST_BROADCAST_QUERIES, k, lambda block: _partial_cosines(known, block, asked.schema, k, scope))


def _by_scope(batch: pa.RecordBatch, scope: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of a batch for each value of its scope columns; all of them if there are none."""
    if not scope:
        yield (), batch
        return
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in scope])):
        rows.setdefault(key, []).append(i)
    for key, at in rows.items():
        yield key, batch.take(pa.array(at))


def _slices(batches: Iterator[pa.RecordBatch], scope: list[str], known: dict[tuple, int]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of one scope at a time, as many as its number of queries allows."""
    for whole in batches:
        for key, batch in _by_scope(whole, scope):
            step = max(1, min(1024, MOST_SCORES // max(1, known.get(key, 1))))
            for lo in range(0, batch.num_rows if key in known else 0, step):
                yield key, batch.slice(lo, step)


def _partial_cosines(points: DataFrame, asked: list[Row], kinds: StructType, k: int, scope: list[str]) -> DataFrame:
    """(query_id, id, score): the k best of every task per query, as products of matrices."""
    by_scope: dict[tuple, dict[int, list]] = {}
    for row in asked:  # at most MOST_BROADCAST_QUERIES rows
        q = np.array([np.nan if x is None else x for x in row["vector"]], float)
        if len(q) and np.isfinite(q).all() and q.any():
            by_scope.setdefault(tuple(row[c] for c in scope), {}).setdefault(len(q), []).append((row["query_id"], q / np.linalg.norm(q)))
    shared = points.sparkSession.sparkContext.broadcast({s: {w: ([n for n, _ in rows], np.stack([q for _, q in rows])) for w, rows in by_width.items()} for s, by_width in by_scope.items()})
    schema = f"query_id {kinds['query_id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(key, width): _Best(len(names), k) for key, widths in shared.value.items() for width, (names, _) in widths.items()}
        most = {key: max(len(names) for names, _ in widths.values()) for key, widths in shared.value.items()}
        for key, batch in _slices(batches, scope, most):
            widths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for width, (_, matrix) in shared.value[key].items():
                part = batch.filter(pa.array(widths == width))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                length = np.linalg.norm(x, axis=1)
                good = np.flatnonzero(np.isfinite(length) & (length > 0))
                if len(good):
                    best[key, width].add(part.column("id").take(pa.array(good)), np.round((x[good] / length[good, None]) @ matrix.T, 9))
        for (key, width), found in best.items():
            if (rows := found.batch(shared.value[key][width][0])) is not None:
                yield rows

    return points.mapInArrow(score, schema)


def terms(rows: DataFrame, id_column: str, text: str = "text", also: list[str] | None = None) -> DataFrame:
    """(id, term, weight): distinct words of a text, lower case, with their counts; ``also`` are kept beside the id."""
    return rows.select(F.col(id_column).alias("id"), F.explode(words(F.col(text))).alias("term"), *(also or [])).groupBy("id", "term", *(also or [])).agg(F.count("*").cast("double").alias("weight"))


def _partial_products(postings: DataFrame, asked: list[Row], kinds: StructType, k: int, scope: list[str]) -> DataFrame:
    """(query_id, id, score): the k best of every task per query, as sparse products.

    ``postings`` has id and its distinct terms with their weights as two lists. The queries of a scope
    are held by term, so a document costs as many steps as its terms have places in queries.
    """
    terms_ = sorted({r["term"] for r in asked})
    line = {t: i for i, t in enumerate(terms_)}
    by_scope: dict[tuple, list[Row]] = {}
    for r in asked:
        by_scope.setdefault(tuple(r[c] for c in scope), []).append(r)
    held = {}
    for key, rows in by_scope.items():
        names = sorted({r["query_id"] for r in rows})
        column = {n: i for i, n in enumerate(names)}
        term, query = np.array([line[r["term"]] for r in rows]), np.array([column[r["query_id"]] for r in rows])
        order = np.argsort(term, kind="stable")
        held[key] = (names, np.searchsorted(term[order], np.arange(len(terms_) + 1)), query[order], np.array([r["_w"] for r in rows], float)[order])
    shared = postings.sparkSession.sparkContext.broadcast((terms_, held))
    schema = f"query_id {kinds['query_id'].dataType.simpleString()}, id {postings.schema['id'].dataType.simpleString()}, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, asked_in = shared.value
        values = pa.array(vocabulary, pa.string())
        best = {key: _Best(len(names), k) for key, (names, *_) in asked_in.items()}
        for key, batch in _slices(batches, scope, {key: len(names) for key, (names, *_) in asked_in.items()}):
            names, first, query, weight = asked_in[key]
            terms_of = batch.column("terms")
            at = pc.index_in(terms_of.flatten(), value_set=values)
            hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms_of).to_numpy(zero_copy_only=False))[hit]
            counts, at = batch.column("weights").flatten().to_numpy(zero_copy_only=False)[hit], at.drop_null().to_numpy()
            n = first[at + 1] - first[at]
            place = np.arange(n.sum()) + np.repeat(first[at] - (np.cumsum(n) - n), n)
            total = np.bincount(np.repeat(owner, n) * len(names) + query[place], np.repeat(counts, n) * weight[place], batch.num_rows * len(names)).reshape(batch.num_rows, -1)
            best[key].add(batch.column("id"), np.where(total > 0, total, -np.inf))
        for key, found in best.items():
            if (rows := found.batch(asked_in[key][0])) is not None:
                yield rows

    return postings.mapInArrow(score, schema)


def sparse_search(postings: DataFrame, queries: DataFrame, k: int = SPARSE_TOP, scope: list[str] | None = None) -> DataFrame:
    """(query_id, id, score, rank) from postings (id, term, weight) and queries (query_id, term, weight).

    Only terms that queries have take part. The queries are broadcast in bounded blocks, and each
    task hands on its k best per query, so nothing of the size of the join is shuffled. Weights are
    taken to be positive; null ids and terms match nothing. ``scope`` is that of dense_search.
    """
    scope = scope or []
    asked = queries.where("query_id is not null and term is not null").select("query_id", "term", F.col("weight").cast("double").alias("_w"), *scope)
    kept = postings.where("id is not null and term is not null").groupBy("id", *scope)
    lists = kept.agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("weight").cast("double")).alias("weights"))
    return _in_blocks(asked, MOST_BROADCAST_TERMS, k, lambda block: _partial_products(lists, block, asked.schema, k, scope))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, top: int = FUSED_TOP) -> DataFrame:
    """(query_id, id, rrf_score, dense_rank, sparse_rank, fused_rank) by reciprocal ranks.

    Ties go to the better dense rank, ids only in sparse last, then to the better sparse rank.
    """
    named = lambda df, source: df.select("query_id", "id", F.lit(source).alias("source"), "rank")
    both = named(dense, "dense").unionByName(named(sparse, "sparse"))
    of = lambda source: F.min(F.when(F.col("source") == source, F.col("rank")))
    scored = both.groupBy("query_id", "id").agg(of("dense").alias("dense_rank"), of("sparse").alias("sparse_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    scored = scored.withColumn("rrf_score", share("dense_rank") + share("sparse_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    return scored.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= top)


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column], top_k: int = RERANK_TOP) -> DataFrame:
    """Candidates (query_id, query, text, fused_rank) by ``scorer``; never more than ten, ties by fused rank."""
    scored = candidates.withColumn("reranker_score", scorer(F.col("query"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("reranker_score"), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(top_k, RERANK_TOP))


def expand_overflow(hits: DataFrame, chunks: DataFrame, hops: int = MOST_HOPS, chain: str | None = None) -> DataFrame:
    """``hits`` (query_id, chunk_id, ...) with overflow_chunks: the next parts, in order, at most ``hops``.

    Only forward; the walk stops at a null or missing successor, and a cycle ends at the bound. Where a
    column ``chain`` says which chunks are parts of one text, their part numbers are one join;
    otherwise links are followed by one join a hop, for all hits at once.
    """
    asked = hits.select("query_id", F.col("chunk_id").alias("start"))
    if chain is not None:
        parts = chunks.where(F.col(chain).isNotNull() & F.col("overflow_sequence.part").isNotNull()).select(F.col(chain).alias("_chain"), F.col("overflow_sequence.part").alias("_part"), F.col("chunk_id").alias("id"), "text")
        wanted = asked.join(parts.select(F.col("id").alias("start"), "_chain", "_part"), "start").withColumn("hop", F.explode(F.sequence(F.lit(1), F.lit(hops))))
        found = wanted.withColumn("_part", F.col("_part") + F.col("hop")).join(parts, ["_chain", "_part"]).select("query_id", F.col("start").alias("chunk_id"), "hop", "id", "text")
    else:
        links = chunks.where("overflow_sequence is not null").select("chunk_id", "text", F.col("overflow_sequence.next_chunk_id").alias("next"))
        step, found = asked.join(links.select(F.col("chunk_id").alias("start"), "next"), "start").where("next is not null"), None
        for hop in range(1, hops + 1):
            at = step.join(links.select(F.col("chunk_id").alias("next"), "text", F.col("next").alias("after")), "next")
            part = at.select("query_id", F.col("start").alias("chunk_id"), F.lit(hop).alias("hop"), F.col("next").alias("id"), "text")
            found = part if found is None else found.unionByName(part)
            step = at.select("query_id", "start", F.col("after").alias("next")).where("next is not null")
    # A missing part ends the walk, so only hops without a gap before them stay.
    walked = F.filter(F.array_sort(F.collect_list(F.struct("hop", "id", "text"))), lambda x, i: x["hop"] == i + 1)
    lists = found.groupBy("query_id", "chunk_id").agg(F.transform(walked, lambda x: F.struct(x["id"].alias("chunk_id"), x["text"].alias("text"))).alias("overflow_chunks"))
    none = F.expr("cast(array() as array<struct<chunk_id: string, text: string>>)")
    return hits.join(lists, ["query_id", "chunk_id"], "left").withColumn("overflow_chunks", F.coalesce("overflow_chunks", none))


def keep_first(hits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of hits with equal key the first in ``order``."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def cross_references(retrieved: DataFrame, chunks: DataFrame, scored: DataFrame, top: int = 3, strip_labels: bool = False) -> DataFrame:
    """(query_id, chunk_id, section): the best chunks of sections that retrieved chunks refer to.

    ``retrieved`` has query_id, chunk_id and cross_references_internal; ``scored`` has chunk_id
    and score, and query_id if scores are those of the original query. References match section numbers exactly unless
    labels are stripped. Chunks already retrieved are left out, each chunk counts once, for the
    smallest section.
    """
    section = F.col("ref")
    refs = retrieved.select("query_id", F.explode("cross_references_internal").alias("ref"))
    refs = refs.select("query_id", (F.regexp_replace(section, r"\(.*$", "") if strip_labels else section).alias("section")).distinct()
    found = refs.join(chunks.select("chunk_id", F.col("section_number").alias("section")), "section").join(scored, [c for c in ("query_id", "chunk_id") if c in scored.columns])
    best = ranked(found, ["query_id", "section"], "score", ["chunk_id"], top)
    return keep_first(best.join(retrieved.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"), ["query_id", "chunk_id"], ["section"]).select("query_id", "chunk_id", "section")


def last_definitions(rows: DataFrame, order: list[str]) -> DataFrame:
    """(query_id, definitions): a map from term to text per query; of several texts of a term the last in ``order`` stays."""
    place = F.struct(*order, "text")
    last = rows.where("query_id is not null and term is not null").groupBy("query_id", "term").agg(F.max_by("text", place).alias("text"))
    return last.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "text")))).alias("definitions"))


def definitions(hits: DataFrame, top: int = 3) -> DataFrame:
    """Per (query_id, term) the hit that defines the term, else the best one, with exact_match.

    ``hits`` has query_id, term, chunk_id, defines and rank; of several exact ones the best rank wins.
    """
    exact = F.coalesce(F.lower("defines") == F.lower("term"), F.lit(False))
    near = hits.where(F.col("rank") <= top).withColumn("exact_match", exact)
    order = Window.partitionBy("query_id", "term").orderBy(F.desc("exact_match"), "rank")
    return near.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def search(points: DataFrame, queries: DataFrame, top_k: int | None = None, use_reranker: bool = False, scorer: Callable[[Column, Column], Column] | None = None, filters: dict[str, str | None] | None = None) -> DataFrame:
    """Hybrid search of a batch of queries (query_id, query, vector) over points.

    ``points`` has point_id, chunk_id, text, dense and the filter columns. Filters apply before any
    ranking, only ids and ranks go through fusion, and texts are joined to the survivors, which are
    broadcast if they are few, so that texts are not shuffled. With the reranker 20 candidates are
    scored and at most 10 come out, otherwise top_k; without top_k (or 0) it is 20.
    """
    top_k = top_k or FUSED_TOP
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be from 1 to 100")
    kept = points.where(predicate(filters or {}))
    dense = dense_search(kept, queries)
    asked = terms(queries, "query_id", "query").withColumnRenamed("id", "query_id")
    sparse = sparse_search(terms(kept, "point_id"), asked)
    fused = small(fuse(dense, sparse, top=FUSED_TOP if use_reranker else top_k), "fused")
    full = kept.drop("dense", "sparse").withColumnRenamed("point_id", "id").join(fused, "id")
    if not use_reranker:
        return full.withColumn("rank", F.col("fused_rank")).withColumn("reranker_score", F.lit(None).cast("double"))
    from statuta.plans.providers import overlap_score

    return rerank(full.join(queries.select("query_id", "query"), "query_id"), scorer or overlap_score, top_k).drop("query")


def results(hits: DataFrame) -> DataFrame:
    """Hits of ``search`` as results: fixed columns, defaults, and the rest as one ``metadata`` struct."""
    known = lambda name, kind="string": F.col(name).cast(kind) if name in hits.columns else F.lit(None).cast(kind)
    none = F.expr("cast(array() as array<string>)")
    about = ("part_number", "chapter_number", "section_number", "source_file")
    more = [known(name).alias(name) for name in about]
    more += [F.coalesce(known("cross_references_internal", "array<string>"), none).alias("cross_references_internal"), F.coalesce(known("paragraph_labels", "array<string>"), none).alias("paragraph_labels"), F.coalesce(known("metrics", "array<string>"), none).alias("metrics")]
    hierarchy = [F.col("hierarchy")] if "hierarchy" in hits.columns else []
    return hits.select("query_id", "rank", "chunk_id", known("rrf_score", "double").alias("score"), known("reranker_score", "double").alias("reranker_score"), F.coalesce(known("text"), F.lit("")).alias("text"), F.coalesce(known("cfr_citation"), F.lit("")).alias("cfr_citation"), F.coalesce(known("chunk_type"), F.lit("")).alias("chunk_type"), known("section_preamble").alias("section_preamble"), known("defines").alias("defines"), *hierarchy, F.struct(*more).alias("metadata"))


def compact(hits: DataFrame) -> DataFrame:
    """The columns of a result that a claim's mapping or an answer shows: no hierarchy, no parts; one score, the reranker's first."""
    return hits.select("query_id", "rank", "chunk_id", "text", "cfr_citation", "chunk_type", "section_preamble", "defines", F.coalesce("reranker_score", "score", F.lit(0.0)).alias("score"), F.col("metadata.part_number").alias("part_number"), F.col("metadata.section_number").alias("section_number"))
