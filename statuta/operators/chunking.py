"""Paragraph-level chunks from the element table, with windows instead of a stack.

The stack machine of compound labels is a window: with ``numbered`` true while a number label is
open, an ambiguous letter is a Roman numeral, and the ancestor at level l of a row is the label of
the last earlier row of level l or less, if that row's level is l.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import regulatory as R
from statuta.functions.text import approx_tokens
from statuta.operators.ordered import first_so_far, islands, joined, occurrences

SECTION = ["source_file", "section_seq"]
HIERARCHY = ("title", "chapter", "subchapter", "part", "subpart", "section", "paragraph")


def label_levels(rows: DataFrame, group: list[str], order: str, label: str = "raw") -> DataFrame:
    """``rows`` with the effective ``level``: ambiguous letters are level 3 while a number label is open."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    raw = F.col(label)
    ambiguous = (raw["level"] == 1) & F.substring(raw["label"], 2, 1).isin(R.ROMAN_LETTERS)
    flag = F.when(raw["level"] == 2, True).when((raw["level"] == 1) & ~ambiguous, False)
    numbered = F.coalesce(F.last(flag, ignorenulls=True).over(before), F.lit(False))
    return rows.withColumn("level", F.when(ambiguous & numbered, 3).otherwise(raw["level"]))


def label_paths(rows: DataFrame, group: list[str], order: str, label: str = "raw") -> DataFrame:
    """``rows`` with ``level`` and ``label_path``, the compound label; null for rows without label."""
    leveled = label_levels(rows, group, order, label)
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.col(label)["label"]
    above = []
    for level in (1, 2, 3):
        last = F.last(F.when(F.col("level") <= level, F.struct("level", own.alias("label"))), ignorenulls=True).over(before)
        above.append(F.when((F.col("level") > level) & (last["level"] == level), last["label"]))
    path = F.when(own.isNotNull(), F.concat_ws("", *above, own))
    return leveled.withColumn("label_path", path)


def _placed(elements: DataFrame) -> DataFrame:
    """Sections with parsed headings; parts without a number are dropped."""
    rows = elements.where("error is null and section_seq is not null")
    rows = rows.withColumn("_part", R.part_heading(F.col("part_heading"))).where("_part.key is not null")
    sub, subpart = R.subchapter_heading(F.col("subchapter_heading")), R.subpart_heading(F.col("subpart_heading"))
    number = R.section_number(F.col("sectno"))
    hierarchy = F.struct(
        F.struct(F.col("title_number").alias("number"), F.col("title_name").alias("name")).alias("title"),
        F.struct(F.col("chapter_number").alias("number"), F.col("chapter_name").alias("name")).alias("chapter"),
        F.when(sub["key"].isNotNull(), F.struct(sub["key"].alias("letter"), sub["name"].alias("name"))).alias("subchapter"),
        F.struct(F.col("_part.key").alias("number"), F.col("_part.name").alias("name")).alias("part"),
        F.when(F.col("subpart_heading").isNotNull(), F.struct(subpart["key"].alias("letter"), subpart["name"].alias("name"))).alias("subpart"),
        F.struct(number.alias("number"), F.col("subject").alias("name")).alias("section"),
    )
    text = F.when(F.col("kind") == "table", R.markdown_table(F.col("headers"), F.col("cells"))).otherwise(F.col("text"))
    return rows.select(*SECTION, "pos", "tag", "kind", "term", "subject", hierarchy.alias("h"), text.alias("text"))


def _identified(suffix: Column) -> Column:
    h = F.col("h")
    return R.chunk_id(h["title"]["number"], h["chapter"]["number"], h["subchapter"]["letter"], h["part"]["number"], h["subpart"]["letter"], F.replace(h["section"]["number"], F.lit("."), F.lit("-")), suffix)


def _finished(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("label_path").isNotNull(), F.struct(F.col("label_path").alias("label")))
    hierarchy = F.struct(*[F.col("h")[level].alias(level) for level in HIERARCHY[:-1]], label.alias("paragraph"))
    return rows.select(
        "source_file", "section_seq", "seq", "chunk_id", "chunk_type", "cfr_citation", hierarchy.alias("hierarchy"), "section_preamble", "text",
        R.external_citations(F.col("text")).alias("citations"), R.internal_references(F.col("text")).alias("cross_references_internal"),
        approx_tokens(F.col("text")).alias("token_count_approx"), F.col("overflow_sequence").isNotNull().alias("is_overflow_chunk"), "overflow_sequence", "defines",
    )


NO_OVERFLOW = "cast(null as struct<part: int, total_parts: int, next_chunk_id: string, prev_chunk_id: string>)"


def definition_chunks(placed: DataFrame, title: str = "21") -> DataFrame:
    """A chunk per paragraph that starts with a term; the first plain paragraph is the preamble of later ones."""
    rows = placed.where(R.is_definitions(F.col("subject")) & F.col("tag").isin("P", "FP") & (F.col("text") != ""))
    rows = first_so_far(rows, SECTION, ["pos"], F.when(F.col("term").isNull(), F.col("text")), "section_preamble").where("term is not null")
    cite = F.concat(R.citation(F.col("h.section.number"), title=title), F.lit(" (definition: "), F.col("term"), F.lit(")"))
    rows = rows.select("*", _identified(F.concat(F.lit("def-"), R.slug(F.col("term")))).alias("chunk_id"), F.lit("definition").alias("chunk_type"), cite.alias("cfr_citation"), F.col("term").alias("defines"), F.lit(None).cast("string").alias("label_path"), F.expr(NO_OVERFLOW).alias("overflow_sequence"), F.col("pos").alias("seq"))
    return _finished(rows)


def paragraph_chunks(placed: DataFrame, title: str = "21", threshold: int = 400) -> DataFrame:
    """Chunks of all other sections: labelled groups, split where too long, or one chunk per section."""
    items = placed.where(~R.is_definitions(F.col("subject")) & F.col("kind").isin("p", "table") & (F.col("text") != ""))
    items = items.withColumn("raw", F.when(F.col("kind") == "p", R.raw_label(F.col("text"))))
    items = label_paths(items, SECTION, "pos")
    items = islands(items, SECTION, ["pos"], F.col("label_path").isNotNull())
    groups = items.groupBy(*SECTION, "island").agg(F.first("h").alias("h"), joined(F.col("text"), F.col("pos")).alias("text"), F.max("label_path").alias("label_path"))
    section = Window.partitionBy(*SECTION)
    groups = groups.withColumn("n_groups", F.max("island").over(section)).withColumn("section_preamble", F.max(F.when((F.col("island") == 0) & (F.col("n_groups") > 0), F.col("text"))).over(section))
    whole = groups.where("n_groups = 0").select("*", _identified(F.lit("sec")).alias("chunk_id"), F.lit("section").alias("chunk_type"), R.citation(F.col("h.section.number"), title=title).alias("cfr_citation"), F.lit(None).cast("string").alias("defines"), F.expr(NO_OVERFLOW).alias("overflow_sequence"), F.lit(0).alias("seq"))
    named = occurrences(groups.where("island > 0"), [*SECTION, "label_path"], ["island"])
    base = F.concat(F.lit("para-"), R.label_suffix(F.col("label_path")), F.when(F.col("n_same") > 1, F.concat(F.lit("-occ"), F.col("occ").cast("string"))).otherwise(""))
    parts = named.withColumn("base", base).withColumn("parts", R.overflow_parts(F.col("text"), threshold)).withColumn("total", F.size("parts")).select("*", F.posexplode("parts").alias("at", "part"))
    numbered = lambda n: F.concat(F.col("base"), F.lit("-part"), n.cast("string"))
    no, many = F.col("at") + 1, F.col("total") > 1
    cite = F.concat(R.citation(F.col("h.section.number"), F.col("label_path"), title), F.when(many, F.format_string(" [part %d of %d]", no, F.col("total"))).otherwise(""))
    sequence = F.when(many, F.struct(no.alias("part"), F.col("total").alias("total_parts"), F.when(no < F.col("total"), _identified(numbered(no + 1))).alias("next_chunk_id"), F.when(no > 1, _identified(numbered(no - 1))).alias("prev_chunk_id")))
    parts = parts.select(*SECTION, "h", "section_preamble", "label_path", F.col("part").alias("text"), _identified(F.when(many, numbered(no)).otherwise(F.col("base"))).alias("chunk_id"), F.lit("paragraph").alias("chunk_type"), cite.alias("cfr_citation"), F.lit(None).cast("string").alias("defines"), sequence.alias("overflow_sequence"), (F.col("island") * 10_000 + F.col("at")).alias("seq"))
    return _finished(whole.withColumn("section_preamble", F.lit(None).cast("string"))).unionByName(_finished(parts))


def chunks(elements: DataFrame, title: str = "21", threshold: int = 400) -> DataFrame:
    """All chunks of parsed files, in the layout of the store; order is (source_file, section_seq, seq).

    Sections without usable elements, definitions sections without terms and rows with ``error``
    give no chunks. Windows are per section, which bounds them.
    """
    placed = _placed(elements)
    return definition_chunks(placed, title).unionByName(paragraph_chunks(placed, title, threshold))


def citation_edges(found: DataFrame) -> DataFrame:
    """Edges (source_id, target, kind) of the lexical graph: refers to, cites, next part and defines."""
    edge = lambda kind, values: F.transform(values, lambda v: F.struct(v.alias("target"), F.lit(kind).alias("kind")))
    every = F.concat(
        edge("refers_to", F.col("cross_references_internal")), edge("cites", F.col("citations")),
        edge("next_part", F.filter(F.array(F.col("overflow_sequence.next_chunk_id")), lambda x: x.isNotNull())), edge("defines", F.filter(F.array(F.col("defines")), lambda x: x.isNotNull())),
    )
    return found.select(F.col("chunk_id").alias("source_id"), F.explode(every).alias("e")).select("source_id", "e.*")
