"""Column functions for regulation texts: labels, references, citations, headings, ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions.text import BLANKS, squeezed

# Patterns of regulation texts. Labels need whitespace after the parenthesis.
NUMBER_LABEL = r"(?U)^\s*\(\s*(\d+)\s*\)\s"
ROMAN_LABEL = r"(?iU)^\s*\(\s*([ivxlcdm]{1,8})\s*\)\s"
CAPITAL_LABEL = r"(?U)^\s*\(\s*([A-Z])\s*\)\s"
LETTER_LABEL = r"(?U)^\s*\(\s*([a-z])\s*\)\s"
INTERNAL_REFERENCE = r"(?iU)§\s*(\d{3,5}\.\d+(?:\([a-z0-9]+\))*)"
US_CODE = r"(?iU)\d+\s+U\.S\.C\.?\s+[\d§\s]+[\d][a-z]?(?:\([a-z0-9]+\))?"
FEDERAL_CODE = r"(?iU)\d+\s+CFR\s+(?:parts?\s+)?\d+(?:\.\d+)?"
FEDERAL_REGISTER = r"(?iU)\d+\s+FR\s+\d+"
EXECUTIVE_ORDER = r"(?iU)E\.O\.\s*\d+|Executive\s+Order\s+\d+"
SUBCHAPTER_HEADING = r"(?iU)^SUBCHAPTER\s+([A-Z]+)\s*[—\-–]\s*(.+)"
PART_HEADING = r"(?iU)PART\s+(\d+[A-Z]?)\s*[—\-–]\s*(.+)"
SUBPART_HEADING = r"(?U)^[Ss]ubpart\s+([A-Z]+)\s*[—\-–]\s*(.+)"
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z(])"
#: Letters that are also Roman numerals.
ROMAN_LETTERS = list("ivxlcdm")


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def raw_label(text: Column) -> Column:
    """struct(level, label) of the label that a paragraph starts with, before its context is known.

    Level 1 is a letter, 2 a number, 3 a Roman numeral of several letters, 4 a capital; null if none.
    """
    number, roman, capital, letter = (_group(text, p) for p in (NUMBER_LABEL, ROMAN_LABEL, CAPITAL_LABEL, LETTER_LABEL))
    made = lambda level, label: F.struct(F.lit(level).alias("level"), F.concat(F.lit("("), label, F.lit(")")).alias("label"))
    return F.when(number.isNotNull(), made(2, number)).when(F.length(roman) > 1, made(3, F.lower(roman))).when(capital.isNotNull(), made(4, capital)).when(letter.isNotNull(), made(1, letter))


def internal_references(text: Column) -> Column:
    """Sorted distinct section references, without the sign."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(INTERNAL_REFERENCE), 1)))


def external_citations(text: Column) -> Column:
    """Sorted distinct citations of code, regulations, register and orders, whitespace normalised."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in (US_CODE, FEDERAL_CODE, FEDERAL_REGISTER, EXECUTIVE_ORDER)])
    return F.array_sort(F.array_distinct(F.transform(found, squeezed)))


def title_case(text: Column) -> Column:
    """Upper case after every non-letter, lower case after letters (so an apostrophe starts a word)."""
    apart = F.regexp_replace(text, r"(?<=[^\p{L}])(?=\p{L})", "\u0000")
    return F.array_join(F.transform(F.split(apart, "\u0000"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.right(w, F.length(w) - 1)))), "")


def _heading(text: Column, pattern: str, titled: bool, upper: bool) -> Column:
    key, name = _group(text, pattern, 1), F.trim(_group(text, pattern, 2))
    key = F.upper(key) if upper else key
    name = title_case(name) if titled else name
    return F.struct(key.alias("key"), F.coalesce(name, squeezed(text)).alias("name"))


def subchapter_heading(text: Column) -> Column:
    return _heading(text, SUBCHAPTER_HEADING, True, True)


def part_heading(text: Column) -> Column:
    return _heading(text, PART_HEADING, True, False)


def subpart_heading(text: Column) -> Column:
    return _heading(text, SUBPART_HEADING, False, True)


def section_number(text: Column) -> Column:
    """Without the section sign, trimmed."""
    return squeezed(F.regexp_replace(text, r"(?U)§\s*", ""))


def is_definitions(subject: Column) -> Column:
    return F.coalesce(F.lower(subject).contains("definition"), F.lit(False))


def dashed(text: Column) -> Column:
    """Every other character than ASCII letters and digits becomes a dash; dashes at the ends go."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]", "-"), "^-+|-+$", "")


def slug(text: Column) -> Column:
    """Lower case; runs of other characters than letters and digits become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def label_suffix(label: Column) -> Column:
    """``(a)(1)`` becomes ``a-1``."""
    return F.regexp_replace(F.replace(F.replace(label, F.lit("("), F.lit("")), F.lit(")"), F.lit("-")), "^-+|-+$", "")


def chunk_id(title: Column, chapter: Column, subchapter: Column, part: Column, subpart: Column, section: Column, suffix: Column) -> Column:
    """Components joined by dashes; those that come out empty are dropped, as nulls are."""
    plain = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    given = lambda c: c.isNotNull() & (c != "")
    parts = [
        title,
        F.when(given(chapter), plain(chapter)).otherwise("X"),
        F.when(given(subchapter), F.concat(F.lit("SC"), plain(subchapter))),
        F.replace(F.replace(part, F.lit(" "), F.lit("")), F.lit("."), F.lit("-")),
        F.when(given(subpart), plain(subpart)).otherwise("nosub"),
        dashed(section),
        dashed(suffix),
    ]
    return F.concat_ws("-", *[F.nullif(p, F.lit("")) for p in parts])


def citation(section: Column, label: Column | None = None, title: str = "21") -> Column:
    return F.concat(F.lit(f"{title} CFR § "), section, *([label] if label is not None else []))


def markdown_table(headers: Column, rows: Column) -> Column:
    """A heading line, a line of dashes and the rows, cells joined by bars; without headings rows only."""
    line = lambda cells: F.array_join(cells, " | ")
    head = F.when(F.size(headers) > 0, F.array(line(headers), line(F.transform(headers, lambda _: F.lit("---"))))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(rows, line)), "\n")


def breadcrumb(hierarchy: Column) -> Column:
    """``Title 21: Food > Part 101: Labels``: levels that are null are left out."""
    labels = []
    for level in ("title", "chapter", "subchapter", "part", "subpart", "section"):
        node = hierarchy[level]
        number = F.lit("") if level in ("subchapter", "subpart") else F.coalesce(node["number"], F.lit(""))
        name = F.coalesce(F.nullif(node["name"], F.lit("")), F.nullif(number, F.lit("")), F.lit(""))
        text = F.concat(F.lit(level.capitalize() + " "), number, F.lit(": "), name)
        labels.append(F.when(node.isNotNull(), F.regexp_replace(text, "^[: ]+|[: ]+$", "")))
    return F.concat_ws(" > ", *labels)


def embed_text(hierarchy: Column, preamble: Column, text: Column, with_preamble: bool = True) -> Column:
    """Breadcrumb, preamble and text, joined by blanks; empty ones are left out but the text."""
    parts = [F.nullif(breadcrumb(hierarchy), F.lit(""))] + ([F.nullif(preamble, F.lit(""))] if with_preamble else [])
    return F.concat_ws(" ", *parts, F.coalesce(text, F.lit("")))


def point_id(chunk: Column) -> Column:
    """The first 32 hexadecimal digits of SHA-256, in groups of 8, 4, 4, 4 and 12."""
    return F.regexp_replace(F.substring(F.sha2(chunk, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def overflow_parts(text: Column, threshold: int = 400, factor: float = 1.35) -> Column:
    """Texts of at most ``threshold`` tokens, filled sentence by sentence; a longer sentence stays whole.

    Sentences count at least one token each, and a text within the threshold is one part.
    """
    tokens = lambda t: F.greatest(F.lit(1), F.floor(F.size(F.array_remove(F.split(t, BLANKS), "")) * F.lit(factor)).cast("int"))
    # Every sentence is counted once, and the fold carries texts that only grow.
    sized = F.transform(F.split(text, SENTENCE_END), lambda s: F.struct(s.alias("s"), tokens(s).alias("n")))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("used"))

    def step(state: Column, sentence: Column) -> Column:
        full = (state["used"] + sentence["n"] > threshold) & state["open"].isNotNull()
        return F.when(full, F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), sentence["s"].alias("open"), sentence["n"].alias("used"))).otherwise(
            F.struct(state["done"].alias("done"), F.concat_ws(" ", state["open"], sentence["s"]).alias("open"), (state["used"] + sentence["n"]).alias("used"))
        )

    filled = F.aggregate(sized, start, step, lambda s: F.when(F.size(s["done"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(F.array(text)))
    return F.when(tokens(text) <= threshold, F.array(text)).otherwise(filled)


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def topic(text: Column) -> Column:
    """A short topic: without a leading label, up to the first full stop if that is near, else 80 characters."""
    bare = F.regexp_replace(text, r"(?U)^\s*\(\s*[A-Za-z0-9]+\s*\)\s+", "")
    lead = F.regexp_extract(bare, r"(?s)^(.{3,80}?)\.\s", 1)
    return F.when(lead != "", lead).otherwise(F.substring(bare, 1, 80))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, default: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(default))))


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def snake_to_title(name: Column) -> Column:
    """Underscores become blanks and every word starts with a capital; other letters stay."""
    return F.array_join(F.transform(F.split(F.replace(name, F.lit("_"), F.lit(" ")), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.right(w, F.length(w) - 1))), " ")


def byte_size(n: Column) -> Column:
    """Bytes, or kilobytes or megabytes with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def counted(n: Column, noun: str) -> Column:
    """``1 issue``, ``2 issues``."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def percent(x: Column) -> Column:
    return F.round(x * 100, 0).cast("int")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where valid, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def trimmed_url(url: Column) -> Column:
    """Without whitespace around it and without slashes at its end."""
    return F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), "/+$", "")


def csv_items(text: Column) -> Column:
    """The parts between commas, each as ``trimmed_url``, in order of first appearance, without empty ones."""
    return distinct_strings(F.transform(F.split(F.coalesce(text, F.lit("")), ","), trimmed_url))


def distinct_strings(values: Column) -> Column:
    """In order of first appearance, without nulls and empty ones."""
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def prefixed(name: Column, provider: str) -> Column:
    """A name with its provider before a slash, once."""
    return F.when(F.startswith(name, F.lit(f"{provider}/")), name).otherwise(F.concat(F.lit(f"{provider}/"), name))


def whole_text(text: Column, parts: Column) -> Column:
    """A text and the texts of its continuation parts, joined by blanks, without nulls and empty ones."""
    more = F.transform(F.coalesce(parts, F.expr("cast(array() as array<struct<chunk_id: string, text: string>>)")), lambda p: p["text"])
    return F.array_join(F.filter(F.concat(F.array(text), more), lambda t: t != ""), " ")


def json_list(raw: Column, element: str = "string") -> Column:
    """The elements of a JSON list; an empty array for other kinds of JSON and for what does not parse."""
    given = F.when(F.substring(F.ltrim(raw), 1, 1) == "[", F.from_json(raw, f"array<{element}>"))
    return F.coalesce(given, F.expr(f"cast(array() as array<{element}>)"))


def token_index(term: Column) -> Column:
    """A term's place in a sparse vector: the first 28 bits of its MD5."""
    return F.conv(F.substring(F.md5(term), 1, 7), 16, 10).cast("int")


def sparse_arrays(weights: Column) -> Column:
    """struct(indices, values) of a map from place to weight, in order of the places."""
    entries = F.array_sort(F.map_entries(weights))
    return F.struct(F.transform(entries, lambda e: e["key"]).alias("indices"), F.transform(entries, lambda e: e["value"]).alias("values"))


def parsed_json(raw: Column, schema: str) -> Column:
    """A struct from a model's answer: the whole text, else the first fenced block that parses; else null."""
    blocks = F.filter(F.transform(F.split(raw, "```"), lambda b: squeezed(F.regexp_replace(F.trim(b), r"^\s*json", ""))), lambda b: F.substring(b, 1, 1).isin("{", "["))
    candidates = F.concat(F.array(raw), blocks)
    parsed = F.transform(F.filter(candidates, lambda c: F.try_parse_json(c).isNotNull()), lambda c: F.from_json(c, schema))
    return F.try_element_at(parsed, F.lit(1))
