"""References to records that do not exist (problem 3), as a fixpoint cascade down the foreign keys."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.text import file_stem, squeezed
from statuta.runtime import cut, salt

#: A key may hold a third of all references: references are spread over this many tasks per key,
#: and the target's keys, one row each, are repeated as often.
WAYS = 8
#: The end of a life that has not ended.
FOREVER = datetime(9999, 12, 31)


@dataclass(frozen=True)
class Table:
    """A table that others refer to: its rows, key, life time, and its own reference if it has one."""

    rows: DataFrame
    key: Column
    since: str
    until: str
    refers_to: str | None = None
    reference: Column | None = None


def records(table: Table) -> DataFrame:
    """The distinct (ref_key, since, until) of a table's rows; those without key or start are no records."""
    rows = table.rows.select(table.key.alias("ref_key"), F.col(table.since).alias("since"), F.col(table.until).alias("until"))
    return rows.where("ref_key is not null and since is not null").distinct()


def lifetimes(rows: DataFrame, name: str = "lives") -> DataFrame:
    """(ref_key, lives): per key the times at which any of its records is alive, as disjoint spans.

    However often a key was loaded, its list is only as long as it has gaps.
    """
    before = Window.partitionBy("ref_key").orderBy("since").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.coalesce("until", F.lit(FOREVER))).over(before)
    spans = rows.where("until is null or until > since").withColumn("_new", F.when(reached >= F.col("since"), 0).otherwise(1))
    spans = spans.withColumn("_span", F.sum("_new").over(Window.partitionBy("ref_key").orderBy("since").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.groupBy("ref_key", "_span").agg(F.min("since").alias("since"), F.max(F.coalesce("until", F.lit(FOREVER))).alias("until"))
    return spans.groupBy("ref_key").agg(F.collect_list(F.struct("since", "until")).alias(name))


def _alive(lives: str, at: str) -> Column:
    return F.expr(f"exists({lives}, x -> x.since <= {at} and x.until > {at})")


def _matched(references: DataFrame, lives: DataFrame, spread: str) -> DataFrame:
    """References with the life times of their target (null if it never existed), hot keys spread."""
    targets = lives.withColumn("_way", F.explode(F.array(*[F.lit(i) for i in range(WAYS)])))
    return references.withColumn("_way", salt(spread, WAYS)).join(targets, ["ref_key", "_way"], "left").drop("_way")


def missing(references: DataFrame, targets: dict[str, Table], spread: str = "result_id") -> DataFrame:
    """The references (with columns target, ref_key and at) without a record alive at their time.

    References whose key, time or target is null say nothing and are left out; ``references`` may
    carry any other columns.
    """
    found = None
    for name, table in targets.items():
        part = references.where((F.col("target") == name) & F.col("ref_key").isNotNull() & F.col("at").isNotNull())
        part = _matched(part, lifetimes(records(table)), spread).where(~F.coalesce(_alive("lives", "at"), F.lit(False))).drop("lives")
        found = part if found is None else found.unionByName(part)
    return found


def cascade(references: DataFrame, targets: dict[str, Table], spread: str = "result_id") -> DataFrame:
    """All references that lead nowhere, with ``orphan_kind``.

    direct: no record of that key is alive at the reference's time. inherited: such records are
    alive, but every one is an orphan itself, because its own reference is direct or inherited.
    Records that became orphans are found by iterating joins down the foreign keys until no new
    one appears; each round is written, so a lost executor does not restart the chain. A record
    with a null reference is no orphan.
    """
    held = {}
    for name, table in targets.items():
        own = table.reference if table.reference is not None else F.lit(None).cast("string")
        held[name] = table.rows.select(table.key.alias("own_key"), F.col(table.since).alias("since"), F.col(table.until).alias("until"), own.alias("ref_key")).distinct()
    broken: dict[str, DataFrame] = {}
    counts: dict[str, int] = {}
    waiting = [name for name, table in targets.items() if table.refers_to is not None]
    while waiting:
        changed = set()
        for name in waiting:
            inner = held[name].where("own_key is not null and since is not null and ref_key is not null").withColumn("at", F.col("since"))
            above = targets[name].refers_to
            lost = cut(_lost(inner, records(targets[above]), broken.get(above), "own_key").select("own_key", "since", "until").distinct(), "orphans")
            broken[name], now = lost, lost.count()
            if now != counts.get(name, 0):
                changed.add(name)
            counts[name] = now
        waiting = [name for name, table in targets.items() if table.refers_to in changed]
    found = None
    for name, table in targets.items():
        part = references.where((F.col("target") == name) & F.col("ref_key").isNotNull() & F.col("at").isNotNull())
        part = _lost(part, records(table), broken.get(name), spread)
        found = part if found is None else found.unionByName(part)
    return found


def _lost(references: DataFrame, known: DataFrame, broken: DataFrame | None, spread: str) -> DataFrame:
    """References without a live record in ``known``, or whose live records are all in ``broken``; with orphan_kind."""
    lives = lifetimes(known)
    if broken is not None:
        gone = broken.select(F.col("own_key").alias("_key"), F.col("since").alias("_since"), F.col("until").alias("_until"))
        rest = known.join(gone, (F.col("ref_key") == F.col("_key")) & (F.col("since") == F.col("_since")) & F.col("until").eqNullSafe(F.col("_until")), "left_anti")
        lives = lives.join(lifetimes(rest, "sound"), "ref_key", "left")
    else:
        lives = lives.withColumn("sound", F.col("lives"))
    matched = _matched(references, lives, spread)
    kind = F.when(~F.coalesce(_alive("lives", "at"), F.lit(False)), "direct").when(~F.coalesce(_alive("sound", "at"), F.lit(False)), "inherited")
    return matched.withColumn("orphan_kind", kind).where("orphan_kind is not null").drop("lives", "sound")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per target table, month of the reference and kind; partial counts before the shuffle."""
    return orphans.groupBy("target", F.date_format("at", "yyyy-MM").alias("month"), "orphan_kind").agg(F.count("*").alias("n_references"), F.approx_count_distinct("ref_key").alias("approx_keys"))


#: Fixed forms of a citation: title, code, optional sign or word, section with an optional letter.
CITATION = r"(?iU)^\s*(\d+)\s*C\.?\s*F\.?\s*R\.?\s*(?:§+|Sec\.?|Sections?)?\s*(\d+\.\d+[a-z]?)(?![a-z0-9])"
SECTION = r"(?iU)^\s*(?:§+|Sec\.?|Sections?)?\s*(\d+\.\d+[a-z]?)(?![a-z0-9])"


def section_key(title: Column, section: Column) -> Column:
    """title_number, a blank and section_number without paragraph labels; null if either is missing."""
    number = F.lower(F.regexp_extract(section, SECTION, 1))
    plain = squeezed(title)
    return F.when((number != "") & (plain != ""), F.concat_ws(" ", plain, number))


def citation_key(citation: Column) -> Column:
    """The same from a whole citation; null if it names no section."""
    title, number = F.regexp_extract(citation, CITATION, 1), F.lower(F.regexp_extract(citation, CITATION, 2))
    return F.when(number != "", F.concat_ws(" ", title, number))


def search_references(results: DataFrame) -> DataFrame:
    """(result_id, at, ref_field, target, ref_key) of all references in search results, distinct per result."""
    title = F.col("hierarchy.title.number")
    one = lambda field, target, key: F.array(F.struct(F.lit(field).alias("ref_field"), F.lit(target).alias("target"), key.alias("ref_key")))
    crossed = F.transform(
        F.coalesce(F.col("metadata.cross_references_internal"), F.array().cast("array<string>")),
        lambda x: F.struct(F.lit("cross_references_internal").alias("ref_field"), F.lit("sections").alias("target"), section_key(title, x).alias("ref_key")),
    )
    every = F.concat(
        one("cfr_citation", "sections", citation_key(F.col("cfr_citation"))),
        one("section_number", "sections", section_key(title, F.col("metadata.section_number"))),
        one("source_file", "source_files", file_stem(F.col("metadata.source_file"))),
        crossed,
    )
    return results.select("result_id", F.col("searched_at").alias("at"), F.explode(F.array_distinct(F.filter(every, lambda x: x["ref_key"].isNotNull()))).alias("_ref")).select("result_id", "at", "_ref.*")


def regulation_targets(sections: DataFrame, source_files: DataFrame) -> dict[str, Table]:
    """The tables that search results refer to; sections refer to files themselves."""
    return {
        "source_files": Table(source_files, file_stem(F.col("source_file")), "registered_at", "withdrawn_at"),
        "sections": Table(sections, section_key(F.col("title_number"), F.col("section_number")), "loaded_at", "deleted_at", "source_files", file_stem(F.col("source_file"))),
    }
