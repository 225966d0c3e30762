"""Splitting oversized items at natural boundaries (problem 5).

Two strategies over the same units (sentences, or runs of words of a sentence that is too long):
``fill`` takes from first to last as many units as fit, which is what p5_found demands; ``bisect``
cuts at the strongest boundary near the midpoint, recurses on halves that still exceed the limit
less the overlap, and then attaches the overlaps.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: where the task lets sentences end.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z(])")
WORD = re.compile(r"\S+")
FACTOR, LIMIT, OVERLAP = 1.35, 400, 60


def tokens(n_words: int) -> int:
    """floor(1.35 x words), at least 1."""
    return max(1, math.floor(FACTOR * n_words))


def words_within(limit: int) -> int:
    """The most words whose tokens are within ``limit``."""
    n = int((limit + 1) / FACTOR) + 1
    while n > 0 and tokens(n) > limit:
        n -= 1
    return n


def units(text: str, preamble_words: int, limit: int = LIMIT) -> list[tuple[int, int, int]]:
    """(start, end, words) of the sentences; one too long beside the preamble gives runs of words.

    A run has at least one word, even if the preamble alone exceeds the limit.
    """
    room, found, start = max(1, words_within(limit) - preamble_words), [], 0
    for end, after in [(m.start(), m.end()) for m in SENTENCE_END.finditer(text)] + [(len(text), len(text))]:
        spans = [m.span() for m in WORD.finditer(text, start, end)]
        if len(spans) <= room:
            found.append((start, end, len(spans)))
        else:
            for i in range(0, len(spans), room):
                part = spans[i : i + room]
                found.append((part[0][0] if i else start, part[-1][1], len(part)))
        start = after
    return found


def fill(weights: list[int], preamble_words: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces as (first unit, unit after the last): each takes as many units as fit.

    A later piece starts with the last unit of the one before if that has at most ``overlap``
    tokens and fits together with the next unit.
    """
    room, pieces, first, at = words_within(limit) - preamble_words, [], 0, 0
    while at < len(weights):
        used = sum(weights[first:at])
        while at < len(weights) and (used + weights[at] <= room or at == first):
            used += weights[at]
            at += 1
        pieces.append((first, at))
        if at < len(weights):
            again = tokens(weights[at - 1]) <= overlap and weights[at - 1] + weights[at] <= room
            first = at - 1 if again else at
    return pieces


def bisect(weights: list[int], strengths: list[int], preamble_words: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces by recursive bisection; strengths[i] is that of the boundary before unit i.

    Among the boundaries in the middle half of a span (by words) the strongest wins, of equals the
    one nearest the midpoint. Halves are cut until they fit beside preamble and overlap; then each
    later piece gets the last unit before it, if that has at most ``overlap`` tokens and fits.
    """
    room = max(1, words_within(limit) - preamble_words)
    small = max(1, room - words_within(overlap))
    ends = [0]
    for w in weights:
        ends.append(ends[-1] + w)
    todo, spans = [(0, len(weights))], []
    while todo:
        a, b = todo.pop()
        if b - a <= 1 or ends[b] - ends[a] <= (room if (a, b) == (0, len(weights)) else small):
            spans.append((a, b))
            continue
        middle, width = (ends[a] + ends[b]) / 2, ends[b] - ends[a]
        near = [i for i in range(a + 1, b) if abs(ends[i] - middle) <= width / 4] or range(a + 1, b)
        cut = max(near, key=lambda i: (strengths[i], -abs(ends[i] - middle)))
        todo += [(cut, b), (a, cut)]
    return [(a - 1, b) if a and tokens(weights[a - 1]) <= overlap and ends[b] - ends[a - 1] <= room else (a, b) for a, b in spans]


def _strength(text: str, start: int) -> int:
    """A paragraph's end counts more than a line's, that more than a sentence's, that more than none."""
    gap = text[max(0, start - 4) : start]
    gap = gap[len(gap.rstrip()) :]
    before = text[: start - len(gap)][-1:] if gap else ""
    return 3 if gap.count("\n") > 1 else 2 if "\n" in gap else 1 if before in (".", "!", "?") else 0


def oversized(results: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(chunk_id, whole, preamble) of the chunks that must be cut, one row per chunk.

    whole is text and the overflow texts in order, joined by single blanks, without nulls, empty
    texts and second entries of one chunk_id. Rows without chunk_id or without any text are left
    out. Short rows are dropped before the rows of a chunk are brought together.
    """
    entries = F.concat(
        F.array(F.struct("chunk_id", "text")),
        F.transform(F.coalesce(F.col("overflow_chunks"), F.expr("cast(array() as array<struct<chunk_id: string, text: string>>)")), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"))),
    )
    kept = F.filter(entries, lambda x: F.coalesce(x["text"], F.lit("")) != "")
    first = F.filter(kept, lambda x, i: x["chunk_id"].isNull() | (F.array_position(F.transform(kept, lambda y: y["chunk_id"]), x["chunk_id"]) == i + 1))
    rows = results.where("chunk_id is not null").select("chunk_id", F.array_join(F.transform(first, lambda x: x["text"]), " ").alias("whole"), F.coalesce("section_preamble", F.lit("")).alias("preamble"))
    count = lambda c: F.size(F.filter(F.split(F.col(c), r"(?U)\s+"), lambda w: w != ""))
    most = words_within(limit)
    long = rows.where(F.length("whole") + F.length("preamble") >= 2 * most).where(count("whole") + count("preamble") > most)
    # A chunk's rows agree; if they do not, the largest text counts.
    return long.where("whole <> ''").groupBy("chunk_id").agg(F.max(F.struct("whole", "preamble")).alias("_x")).select("chunk_id", "_x.*")


def split_items(items: DataFrame, strategy: str = "fill", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece_no, start_char, end_char, n_tokens, piece) of items (chunk_id, whole, preamble).

    piece_no counts from 1, offsets are code points in ``whole`` from 0, and n_tokens includes the
    preamble. A text within the limit gives one piece; null and empty texts give none. Texts are
    processed whole, however long; other columns are ignored.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, preamble in zip(batch["chunk_id"], batch["whole"], batch["preamble"]):
                if not isinstance(text, str) or not text:
                    continue
                before = len(preamble.split()) if isinstance(preamble, str) else 0
                parts = units(text, before, limit)
                weights = [n for _, _, n in parts]
                pieces = fill(weights, before, limit, overlap) if strategy == "fill" else bisect(weights, [_strength(text, s) for s, _, _ in parts], before, limit, overlap)
                for no, (a, b) in enumerate(pieces, 1):
                    start, end = parts[a][0], parts[b - 1][1]
                    rows.append((key, no, start, end, tokens(before + sum(weights[a:b])), text[start:end]))
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "start_char", "end_char", "n_tokens", "piece"])

    return items.select("chunk_id", "whole", "preamble").mapInPandas(cut, "chunk_id string, piece_no int, start_char int, end_char int, n_tokens int, piece string")
