"""Golden cases of the chunker, and the label windows against a stack."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from statuta.functions import regulatory as R
from statuta.operators import chunking
from statuta.sources import regulation_xml as X


def regulation(sections: str, part: str = "PART 101—FOOD LABELING") -> str:
    return f"""<CFRDOC><FDSYS><CFRTITLE>21</CFRTITLE><CFRTITLETEXT>Food and Drugs</CFRTITLETEXT><VOL>2</VOL><GRANULENUM>I</GRANULENUM><TITLE>Agency</TITLE></FDSYS>
    <CHAPTER><TOC>x</TOC><SUBCHAP><HD>SUBCHAPTER B—FOOD</HD><PART><HD>{part}</HD><SUBPART><HD>Subpart A—General</HD>{sections}</SUBPART></PART></SUBCHAP></CHAPTER></CFRDOC>"""


def section(number: str, subject: str, body: str) -> str:
    return f"<SECTION><SECTNO>§ {number}</SECTNO><SUBJECT>{subject}</SUBJECT>{body}<CITA>x</CITA></SECTION>"


def chunked(spark, *documents: str):
    files = spark.createDataFrame([(f"f{i}.xml", bytearray(d.encode())) for i, d in enumerate(documents)], "source_file string, content binary")
    return chunking.chunks(X.parse_elements(files)).orderBy("source_file", "section_seq", "seq").collect()


def test_label_paths(spark):
    texts = ["Intro text.", "(a) First.", "(1) Sub.", "(c) Third.", "plain tail", "(ii) Roman.", "(b)(2) Tight.", "(b) Next.", "(A) Cap."]
    rows = chunked(spark, regulation(section("101.13", "Rules", "".join(f"<P>{t}</P>" for t in texts))))
    assert [r.hierarchy.paragraph.label for r in rows] == ["(a)", "(a)(1)", "(a)(1)(c)", "(a)(1)(ii)", "(b)", "(b)(A)"]
    assert rows[0].chunk_id == "21-I-SCB-101-A-101-13-para-a" and rows[1].chunk_id.endswith("-para-a-1")
    assert rows[0].cfr_citation == "21 CFR § 101.13(a)" and rows[0].token_count_approx == 2
    assert rows[2].text == "(c) Third. plain tail" and rows[3].text == "(ii) Roman. (b)(2) Tight."
    assert {r.section_preamble for r in rows} == {"Intro text."}
    assert rows[0].hierarchy.part.name == "Food Labeling" and rows[0].hierarchy.subchapter.letter == "B" and rows[0].source_file == "f0.xml"


def test_repeated_labels_and_plain_sections(spark):
    rows = chunked(spark, regulation(section("101.1", "A", "<P>(a) x</P><P>(a) y</P>") + section("101.2", "B", "<P>One.</P><P>Two.</P>") + "<SECTION><SECTNO>§ 101.9</SECTNO><RESERVED/><P>(a) z</P></SECTION>"))
    assert [r.chunk_id.split("101-")[-1] for r in rows] == ["1-para-a-occ1", "1-para-a-occ2", "2-sec"]
    assert rows[2].text == "One. Two." and rows[2].section_preamble is None and rows[2].chunk_type == "section"


def test_definitions(spark):
    body = "<P>For this part:</P><P><E>Direct costs</E> means X.</P><P>Other note.</P>"
    (row,) = chunked(spark, regulation(section("101.3", "Definitions", body)))
    assert row.chunk_id == "21-I-SCB-101-A-101-3-def-direct-costs" and row.defines == "Direct costs"
    assert row.section_preamble == "For this part:" and row.cfr_citation == "21 CFR § 101.3 (definition: Direct costs)"


def test_overflow_parts_and_links(spark):
    sentence = lambda tokens: "W" + " w" * (-(-tokens * 100 // 135) - 1) + "."
    text = "(a) " + " ".join(sentence(n) for n in (150, 200, 100, 300, 50))
    rows = chunked(spark, regulation(section("101.5", "Long", f"<P>{text}</P>")))
    assert len(rows) == 3 and [r.overflow_sequence.part for r in rows] == [1, 2, 3]
    assert rows[0].overflow_sequence.next_chunk_id == rows[1].chunk_id and rows[2].overflow_sequence.prev_chunk_id == rows[1].chunk_id
    assert rows[0].overflow_sequence.prev_chunk_id is None and rows[0].cfr_citation.endswith("(a) [part 1 of 3]")
    assert " ".join(r.text for r in rows) == text


def test_mixed_content_tables_and_bad_files(spark):
    assert X.plain_text(X.ET.fromstring("<P>the <E>Act </E>means <PRTPAGE P='1'/>more</P>")) == "the Actmeans more"
    table = "<GPOTABLE><BOXHD><CHED>A</CHED><CHED>B</CHED></BOXHD><ROW><ENT>1</ENT><ENT>2</ENT></ROW></GPOTABLE>"
    rows = chunked(spark, regulation(section("101.6", "T", f"<P>(a) See</P>{table}")), "<broken", "", "<CFRDOC/>", regulation(section("1.1", "N", "<P>x</P>"), part="NO NUMBER"))
    assert [r.text for r in rows] == ["(a) See A | B\n--- | ---\n1 | 2"]
    files = spark.createDataFrame([("bad.xml", bytearray(b"<broken")), ("none.xml", None)], "source_file string, content binary")
    assert X.ingest_errors(X.parse_elements(files)).count() == 2


def test_references_and_ids(spark):
    row = spark.createDataFrame([("see § 101.13(a)(2) and § 1.20, 21 U.S.C. 343(q), 45 CFR part 46, 66 FR  100 and E.O. 12866",)], "t string").select(
        R.internal_references(F.col("t")).alias("i"), R.external_citations(F.col("t")).alias("e"), R.point_id(F.lit("x")).alias("p"), R.extension(F.lit("A.b.PDF")).alias("x"), R.title_case(F.lit("DRIVER'S food")).alias("c")
    ).first()
    assert row.i == ["101.13(a)(2)"] and row.e == ["21 U.S.C. 343(q)", "45 CFR part 46", "66 FR 100", "E.O. 12866"]
    assert row.p == "2d711642-b726-b044-0162-7ca9fbac32f5" and row.x == "pdf" and row.c == "Driver'S Food"


def test_breadcrumb_without_numbers(spark):
    h = "named_struct('title', named_struct('number','21','name','Food'), 'chapter', null, 'subchapter', null, 'part', named_struct('number','101','name',''), 'subpart', named_struct('letter','A','name','General'), 'section', null)"
    types = "struct<title:struct<number:string,name:string>,chapter:struct<number:string,name:string>,subchapter:struct<letter:string,name:string>,part:struct<number:string,name:string>,subpart:struct<letter:string,name:string>,section:struct<number:string,name:string>>"
    frame = spark.sql(f"select cast({h} as {types}) h")
    assert frame.select(R.breadcrumb(F.col("h"))).first()[0] == "Title 21: Food > Part 101: 101 > Subpart : General"
    assert frame.select(R.embed_text(F.col("h"), F.lit("Pre."), F.lit("T."))).first()[0].endswith("General Pre. T.")


def stack_paths(labels: list[tuple[int, str] | None]) -> list[str | None]:
    """Compound labels by an open list: entries of the same or a deeper level are closed first."""
    opened, paths = [], []
    for label in labels:
        if label is None:
            paths.append(None)
            continue
        level, text = label
        if level == 1 and text[1] in "ivxlcdm" and any(n == 2 for n, _ in opened):
            level = 3
        opened = [o for o in opened if o[0] < level] if all(o[0] < level for o in opened) else opened[: next(i for i, o in enumerate(opened) if o[0] >= level)]
        opened.append((level, text))
        paths.append("".join(t for _, t in opened))
    return paths


@pytest.mark.parametrize("seed", [1, 2])
def test_label_windows_equal_a_stack(spark, seed):
    choose = random.Random(seed)
    kinds = [None, (1, "(a)"), (1, "(b)"), (1, "(i)"), (1, "(c)"), (2, "(1)"), (2, "(2)"), (3, "(ii)"), (3, "(iv)"), (4, "(A)"), (4, "(B)")]
    groups = [[choose.choice(kinds) for _ in range(choose.randint(1, 14))] for _ in range(150)]
    rows = [(g, p, None if k is None else {"level": k[0], "label": k[1]}) for g, group in enumerate(groups) for p, k in enumerate(group)]
    frame = spark.createDataFrame(rows, "g int, pos int, raw struct<level: int, label: string>")
    got = {(r.g, r.pos): r.label_path for r in chunking.label_paths(frame, ["g"], "pos").collect()}
    assert got == {(g, p): path for g, group in enumerate(groups) for p, path in enumerate(stack_paths(group))}
