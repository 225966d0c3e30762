"""Regulation XML as an ordered table of elements.

Only the parsing of mixed content is Python (one row per file into mapInArrow); everything that is
relational about chunking happens on the element table, see ``statuta.operators.chunking``.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags of the format that carry no text of a section.
IGNORED_TAGS = {
    "TOC", "TOCHD", "CONTENTS", "CHAPTI", "PTHD", "PGHD", "SECHD", "EAR", "PRTPAGE", "LRH", "RRH", "FAIDS", "ALPHLIST", "EXPLA", "IPAR", "STUB", "SIDEHED", "SIG", "NAME", "POSITION", "OFFICE", "EDNOTE",
}
SECTION_HEADS = {"SECTNO", "SUBJECT", "CITA", "AUTH", "SOURCE", "PRTPAGE", "EAR", "RESERVED"}
TEXT_TAGS, TABLE_TAG, PAGE_TAG = {"P", "FP", "EXTRACT"}, "GPOTABLE", "PRTPAGE"
DEFAULT_TITLE, DEFAULT_CHAPTER = "21", "?"

SCHEMA = (
    "source_file string, title_number string, title_name string, volume string, chapter_number string, chapter_name string, "
    "subchapter_heading string, part_heading string, subpart_heading string, section_seq int, sectno string, subject string, "
    "pos int, tag string, kind string, text string, term string, headers array<string>, cells array<array<string>>, error string"
)
TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
ARROW = pa.schema([(name, TYPES[kind]) for name, kind in (field.split(" ") for field in SCHEMA.split(", "))])


def plain_text(element: ET.Element | None) -> str:
    """Text of a subtree; page marks are left out but not what follows them.

    Each nested element is normalised and trimmed before it is joined to its surroundings.
    """
    if element is None:
        return ""
    done: dict[ET.Element, str] = {}
    stack = [(element, False)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack += [(child, False) for child in node if child.tag != PAGE_TAG]
            continue
        pieces = [node.text or ""]
        for child in node:
            pieces += [done.get(child, ""), child.tail or ""]
        done[node] = " ".join("".join(pieces).split())
    return done[element]


def _sections(part: ET.Element) -> Iterator[tuple[str | None, ET.Element]]:
    """(subpart heading, section): all sections below a subpart, and those directly below the part."""
    for child in part:
        if child.tag == "SUBPART":
            heading = plain_text(child.find("HD"))
            yield from ((heading, section) for section in child.iter("SECTION"))
        elif child.tag == "SECTION":
            yield None, child


def _parts(chapter: ET.Element) -> Iterator[tuple[str | None, ET.Element]]:
    for child in chapter:
        if child.tag == "SUBCHAP":
            heading = plain_text(child.find("HD"))
            yield from ((heading, part) for part in child.findall("PART"))
        elif child.tag == "PART":
            yield None, child


def elements(content: bytes | str, source_file: str) -> Iterator[dict]:
    """A dict per content element in document order; one with ``error`` if the file does not parse."""
    try:
        root = ET.fromstring(content)
    except (ET.ParseError, ValueError) as error:
        yield {"source_file": source_file, "error": str(error)}
        return
    meta = root.find("FDSYS")
    about = (lambda tag, default: plain_text(meta.find(tag))) if meta is not None else (lambda tag, default: default)
    base = {
        "source_file": source_file, "title_number": about("CFRTITLE", DEFAULT_TITLE), "title_name": about("CFRTITLETEXT", ""), "volume": about("VOL", ""),
        "chapter_number": about("GRANULENUM", DEFAULT_CHAPTER), "chapter_name": about("TITLE", ""),
    }
    chapter = root.find("CHAPTER")
    if chapter is None:
        yield base | {"error": "no CHAPTER"}
        return
    seq = 0
    for subchapter, part in _parts(chapter):
        if part.find("RESERVED") is not None:
            continue
        heading = plain_text(part.find("HD"))
        for subpart, section in _sections(part):
            if section.find("RESERVED") is not None or section.find("SECTNO") is None:
                continue
            seq += 1
            here = base | {"subchapter_heading": subchapter, "part_heading": heading, "subpart_heading": subpart, "section_seq": seq, "sectno": plain_text(section.find("SECTNO")), "subject": plain_text(section.find("SUBJECT"))}
            for pos, element in enumerate(e for e in section if e.tag not in SECTION_HEADS and e.tag not in IGNORED_TAGS):
                first = next(iter(element), None)
                row = here | {"pos": pos, "tag": element.tag}
                if element.tag in TEXT_TAGS:
                    term = first.text.strip() if first is not None and first.tag == "E" and first.text else None
                    yield row | {"kind": "p", "text": plain_text(element), "term": term}
                elif element.tag == TABLE_TAG:
                    box = element.find("BOXHD")
                    headers = [plain_text(c) for c in box.findall("CHED")] if box is not None else []
                    yield row | {"kind": "table", "headers": headers, "cells": [[plain_text(e) for e in r.findall("ENT")] for r in element.findall("ROW")]}
                else:
                    yield row | {"kind": "other"}


def parse_elements(files: DataFrame) -> DataFrame:
    """Elements of files (source_file, content).

    A file that is null, empty or malformed, or has no chapter, gives one row with ``error`` and
    nothing else, so that it can be counted; files without usable sections give none.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("source_file").to_pylist(), batch.column("content").to_pylist()):
                if rows := list(elements(content if content is not None else b"", name)):
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.select("source_file", "content").mapInArrow(parse, SCHEMA)


def read_regulations(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """All elements of the files of a folder; raises if no file matches. Order is kept by section_seq and pos."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if files.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return parse_elements(files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content"))


def ingest_errors(found: DataFrame) -> DataFrame:
    return found.where("error is not null").select("source_file", "error")
