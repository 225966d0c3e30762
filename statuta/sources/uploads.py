"""Uploaded documents as rows of text, with an error column instead of failures."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions import regulatory as R

MOST_CHARS = 50_000
NOTICE = "\n\n[Document truncated]"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs that are not blank, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        root = ET.fromstring(parts.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p"))
    return "\n".join(line for line in lines if line.strip())


def pdf_text(content: bytes) -> str:
    """Page texts, a line each; needs an optional library."""
    try:
        import fitz
    except ImportError as error:
        raise ImportError("reading PDF needs PyMuPDF") from error
    with fitz.open(stream=content, filetype="pdf") as pages:
        return "\n".join(page.get_text() for page in pages)


READERS = {"docx": docx_text, "pdf": pdf_text}


def read_uploads(files: DataFrame) -> DataFrame:
    """(document_name, text, error, full_text) of files (document_name, content).

    The extension decides: docx and pdf are parsed, doc is refused, all else is text in UTF-8 or else
    Latin-1 without leaving the JVM. Empty files and texts that are blank or do not parse have an
    error and null texts. full_text is whole, for rules; text is for prompts: over 50,000 characters
    it is cut there and gets a notice.
    """
    kind = R.extension(F.col("document_name"))
    filled = files.select("document_name", "content", kind.alias("_kind"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content, kind in zip(batch["document_name"], batch["content"], batch["_kind"]):
                try:
                    rows.append((name, READERS[kind](content or b""), None))
                except Exception as error:
                    rows.append((name, None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["document_name", "text", "error"])

    parsed = filled.where(F.col("_kind").isin(list(READERS)) & (F.length("content") > 0)).mapInPandas(parse, "document_name string, text string, error string")
    plain = filled.where(~F.coalesce(F.col("_kind"), F.lit("")).isin("doc", *READERS) | (F.coalesce(F.length("content"), F.lit(0)) == 0))
    plain = plain.select("document_name", F.when(F.length("content") > 0, R.decoded(F.col("content"))).alias("text"), F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty file").alias("error"))
    old = filled.where((F.col("_kind") == "doc") & (F.length("content") > 0)).select("document_name", F.lit(None).cast("string").alias("text"), F.lit("legacy Word files are not supported").alias("error"))
    rows = parsed.unionByName(plain).unionByName(old).withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    rows = rows.withColumn("error", F.when(F.col("error").isNull() & (F.coalesce("text", F.lit("")) == ""), "no text").otherwise(F.col("error")))
    text = F.when(F.length("text") > MOST_CHARS, F.concat(R.first_chars(F.col("text"), MOST_CHARS), F.lit(NOTICE))).otherwise(F.nullif("text", F.lit("")))
    return rows.select("document_name", text.alias("text"), "error", F.nullif("text", F.lit("")).alias("full_text"))
