"""Evaluation texts leaking into training text (problem 8).

One Aho-Corasick automaton over the normalised evaluation texts scans every document once. Its
patterns are the aligned blocks of n // 2 words of each text: every run of n words contains one
whole block, so none is missed, and the automaton stays small. Hits are extended word by word to
the longest common run, and runs of n words or more are reported with offsets in the original.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.runtime import spread

WORD = re.compile(r"[^\W_]+")
GAP = re.compile(r"[\W_]+")
#: Evaluation texts are broadcast in blocks of so many characters, each a pass over the documents. (260 items
#: have 0.3 million; the automaton takes about 45 bytes a character in every worker.)
BLOCK_CHARS = 8_000_000
RUN = 12


def eval_texts(items: DataFrame, fields: list[str]) -> Iterator[list[tuple[str, str, list[int]]]]:
    """(field, text, item ids) of the distinct texts, in blocks of bounded size."""
    rows = items.where("item_id is not null").select("item_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("item_id", "x.*").where("text is not null")
    texts = rows.groupBy("field", "text").agg(F.sort_array(F.collect_set("item_id")).alias("ids")).orderBy("field", "text")
    block, size = [], 0
    for field, text, ids in texts.toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((field, text, list(ids)))
        size += len(text)
    if block:
        yield block


class Scanner:
    """The automaton with what is needed to extend its hits."""

    def __init__(self, texts: list[tuple[str, str, list[int]]], run: int, short: bool = False) -> None:
        self.run, self.block = run, max(1, run // 2)
        self.words = [WORD.findall(text.lower()) for _, text, _ in texts]
        self.least = [min(run, len(words)) if short else run for words in self.words]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, words in enumerate(self.words):
            if len(words) >= run:
                for at in range(0, len(words) - self.block + 1, self.block):
                    places[" " + " ".join(words[at : at + self.block]) + " "].append((n, at))
            elif words and short:
                places[" " + " ".join(words) + " "].append((n, 0))
        self.automaton = ahocorasick.Automaton()
        for pattern, where in places.items():
            self.automaton.add_word(pattern, (len(pattern), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """(text no, first word of the run there, start, end) with offsets in ``text``; longest runs only."""
        if self.empty:
            return []
        plain = " " + GAP.sub(" ", text.lower()) + " "
        plain = plain.replace("  ", " ")
        hits = list(self.automaton.iter(plain))
        if not hits:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        if (again := " " + " ".join(words) + " ") != plain:  # lower-casing has changed the length of a letter
            plain, hits = again, list(self.automaton.iter(again))
        starts = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le"), np.uint32) == 32)
        reached: dict[tuple[int, int], int] = {}
        found = []
        for end, (length, where) in hits:
            first = bisect_left(starts, end - length + 1)
            for n, at in where:
                if reached.get((n, first - at), -1) >= first:
                    continue
                other = self.words[n]
                a, b = first, at
                while a and b and words[a - 1] == other[b - 1]:
                    a, b = a - 1, b - 1
                c, d = first, at
                while c < len(words) and d < len(other) and words[c] == other[d]:
                    c, d = c + 1, d + 1
                reached[n, first - at] = c
                if c - a >= self.least[n]:
                    found.append((n, b, spans[a][0], spans[c - 1][1]))
        return found


def find_leaks(documents: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("passage",), run: int = RUN, short: bool = False) -> DataFrame:
    """(doc_id, item_id, field, start_char, end_char): every maximal run of at least ``run`` words.

    Words are longest runs of letters and digits, lower-cased; nothing else between them counts.
    Evaluation texts of fewer words cannot leak, or with ``short`` do where all their words stand. Items that share a text are all reported. Null,
    empty and wordless texts have no leaks; long ones are scanned whole; repeated documents give
    repeated rows; other columns are ignored. Evaluation texts beyond ``BLOCK_CHARS`` are scanned for in
    further passes.
    """
    rows = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id")
    schema = "doc_id long, item_id long, field string, start_char int, end_char int"
    found = None
    for block in eval_texts(items, list(fields)):
        part = rows.mapInPandas(_scan(documents.sparkSession.sparkContext.broadcast(block), run, short), schema)
        found = part if found is None else found.unionByName(part)
    return documents.sparkSession.createDataFrame([], schema) if found is None else found


def _scan(texts: Broadcast, run: int, short: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(texts.value, run, short)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for n, _, start, end in scanner.scan(text):
                    field, _, ids = texts.value[n]
                    rows += [(doc_id, item_id, field, start, end) for item_id in ids]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "field", "start_char", "end_char"])

    return scan
