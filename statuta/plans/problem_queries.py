"""The pN_ queries of the general problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import nested, orphans, snapshots
from statuta.plans.nested_sql import NODES
from statuta.runtime import read


#: The column of each level's table that holds its own key.
KEYS = nested.LEVELS | {"chunk": "chunk_id", "metric": "position"}


def _p1_tables(spark: SparkSession, folder: str, shared_only: bool = False) -> dict[str, DataFrame]:
    return nested.subtype_tables(nested.flatten_nodes(read(spark, folder, "chunk_files")), shared_only)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of all typed tables."""
    return nested.common(_p1_tables(spark, folder, shared_only=True)).select("file_id", "node_key", "parent_key")


def _level(level: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.level_table(_p1_tables(spark, folder), level).select("file_id", "node_key", "parent_key", KEYS[level])

    query.__name__ = f"p1_{level}s"
    return query


def p1_measures(spark: SparkSession, folder: str) -> DataFrame:
    """The typed table of the metrics that have a value or a unit."""
    return _p1_tables(spark, folder)["measure"].drop("level")


def p1_located_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The typed table of the chunks that carry their own hierarchy."""
    return _p1_tables(spark, folder)["chunk_with_path"].drop("level")


def p1_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes per structural variant and level."""
    return nested.common(_p1_tables(spark, folder, shared_only=True)).groupBy("variant", "level").agg(F.count("*").alias("n_nodes"))


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, orphans.Table]]:
    return orphans.search_references(read(spark, folder, "search_results")), orphans.regulation_targets(read(spark, folder, "sections"), read(spark, folder, "source_files"))


def p3_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.cascade(*_references(spark, folder)).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_orphans(spark, folder).where("orphan_kind = 'direct'").select("result_id", "ref_field", "ref_key").distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(p3_orphans(spark, folder)).drop("approx_keys")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_changes(read(spark, folder, "chunk_snapshots"), "chunk_id", ["text", "cfr_citation"])


def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Changes per delivery and kind."""
    return p6_found(spark, folder).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n_chunks"))


P1_TABLES = [_level(level) for level in (*nested.LEVELS, "chunk", "metric")]
QUERIES = {f.__name__: f for f in (p1_found, p1_variants, p1_measures, p1_located_chunks, *P1_TABLES, p3_found, p3_report, p6_found, p6_summary)}

_TEXT = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{00a0}}]+', ' ', 'g'))"
_REFS = r"""
WITH r AS (
  SELECT DISTINCT result_id, searched_at AS ts, cfr_citation AS cit, metadata.section_number AS sec, metadata.source_file AS sf,
         metadata.cross_references_internal AS xr, trim(hierarchy.title.number) AS title FROM search_results),
f AS (
  SELECT result_id, ts, 'cfr_citation' AS ref_field, 'sections' AS target,
         regexp_extract(lower(cit), '^[\s\x{00a0}]*([0-9]+)[\s\x{00a0}]*c\.?f\.?r\.?[\s\x{00a0}]*(?:§|sec\.?)?[\s\x{00a0}]*([0-9]+\.[0-9]+[a-z]?)', 1) || ' ' ||
         regexp_extract(lower(cit), '^[\s\x{00a0}]*([0-9]+)[\s\x{00a0}]*c\.?f\.?r\.?[\s\x{00a0}]*(?:§|sec\.?)?[\s\x{00a0}]*([0-9]+\.[0-9]+[a-z]?)', 2) AS ref_key FROM r
  UNION ALL SELECT result_id, ts, 'section_number', 'sections', title || ' ' || regexp_extract(lower(sec), '^[\s§\x{00a0}]*([0-9]+\.[0-9]+[a-z]?)', 1) FROM r
  UNION ALL SELECT result_id, ts, 'cross_references_internal', 'sections', title || ' ' || regexp_extract(lower(x), '^[\s§\x{00a0}]*([0-9]+\.[0-9]+[a-z]?)', 1) FROM (SELECT result_id, ts, title, unnest(xr) AS x FROM r)
  UNION ALL SELECT result_id, ts, 'source_file', 'source_files', regexp_extract(trim(lower(sf)), '([^/]*)$', 1) FROM r),
refs AS (SELECT DISTINCT * FROM f WHERE ref_key IS NOT NULL AND ts IS NOT NULL AND ref_key <> '' AND ref_key <> ' ' AND NOT ends_with(ref_key, ' ')),
recs AS (
  SELECT 'sections' AS target, trim(title_number) || ' ' || lower(trim(section_number)) AS ref_key, loaded_at AS since, deleted_at AS until, lower(source_file) AS parent FROM sections
  UNION ALL SELECT 'source_files', lower(source_file), registered_at, withdrawn_at, NULL FROM source_files),
sound AS (
  SELECT * FROM recs WHERE parent IS NULL OR EXISTS (SELECT 1 FROM recs p WHERE p.target = 'source_files' AND p.ref_key = recs.parent AND p.since <= recs.since AND (p.until IS NULL OR p.until > recs.since))),
direct AS (SELECT * FROM refs WHERE NOT EXISTS (SELECT 1 FROM recs t WHERE t.target = refs.target AND t.ref_key = refs.ref_key AND t.since <= ts AND (t.until IS NULL OR t.until > ts))),
nowhere AS (SELECT * FROM refs WHERE NOT EXISTS (SELECT 1 FROM sound t WHERE t.target = refs.target AND t.ref_key = refs.ref_key AND t.since <= ts AND (t.until IS NULL OR t.until > ts)))
"""
_CHANGES = f"""
WITH n AS (
  SELECT snapshot_no AS no, chunk_id AS id, {_TEXT.format("text")} AS t, {_TEXT.format("cfr_citation")} AS c FROM chunk_snapshots
  WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_no, chunk_id ORDER BY loaded_at DESC NULLS LAST) = 1),
s AS (SELECT no, lag(no) OVER (ORDER BY no) AS before FROM (SELECT DISTINCT no FROM n)),
d AS (
  SELECT s.no AS snapshot_no, n.id AS chunk_id, CASE WHEN o.id IS NULL THEN 'added' WHEN o.t <> n.t OR o.c <> n.c THEN 'changed' END AS change_kind
  FROM s JOIN n ON n.no = s.no LEFT JOIN n o ON o.no = s.before AND o.id = n.id WHERE s.before IS NOT NULL
  UNION ALL SELECT s.no, o.id, 'removed' FROM s JOIN n o ON o.no = s.before LEFT JOIN n ON n.no = s.no AND n.id = o.id WHERE n.id IS NULL)
"""
ORACLE = {
    "p1_found": NODES + "SELECT DISTINCT file_id, node_key, parent_key FROM nodes",
    **{f"p1_{level}s": NODES + f"SELECT DISTINCT file_id, node_key, parent_key, own_key{'::INT' if level == 'metric' else ''} AS {KEYS[level]} FROM nodes WHERE level = '{level}'" for level in KEYS},
    "p3_found": _REFS + "SELECT DISTINCT result_id, ref_field, ref_key FROM direct",
    "p3_report": _REFS
    + """SELECT target, strftime(ts, '%Y-%m') AS month, kind AS orphan_kind, count(*) AS n_references FROM (
      SELECT *, 'direct' AS kind FROM direct UNION ALL SELECT *, 'inherited' FROM (SELECT * FROM nowhere EXCEPT SELECT * FROM direct)) GROUP BY ALL""",
    "p6_found": _CHANGES + "SELECT * FROM d WHERE change_kind IS NOT NULL",
    "p6_summary": _CHANGES + "SELECT snapshot_no, change_kind, count(*) AS n_chunks FROM d WHERE change_kind IS NOT NULL GROUP BY ALL",
}
