from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statuta.llm import packing, split

WEIGHTS = st.lists(st.integers(1, 297), min_size=1, max_size=60)


def words(n, start="W"):
    return " ".join([start, *["w"] * (n - 2)][: n - 1] + ["end."]) if n > 1 else "End."


@given(WEIGHTS)
@settings(max_examples=300, deadline=None)
def test_filled_pieces(weights):
    room, pieces = split.words_within(400), split.fill(weights, 0)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(weights)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert sum(weights[a:b]) <= room and c in (b, b - 1) and d > b
        assert sum(weights[a : b + 1]) > room  # no further unit fits
        assert (c == b - 1) == (split.tokens(weights[b - 1]) <= 60 and weights[b - 1] + weights[b] <= room)


@given(WEIGHTS)
@settings(max_examples=300, deadline=None)
def test_bisected_pieces(weights):
    pieces = split.bisect(weights, [1] * len(weights), 0)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(weights)
    assert all(c in (b, b - 1) for (_, b), (c, _) in zip(pieces, pieces[1:])) and all(sum(weights[a:b]) <= 297 for a, b in pieces)


def test_bisection_takes_the_strongest_boundary():
    assert split.bisect([100, 100, 100, 100], [0, 1, 1, 1], 0) == [(0, 2), (2, 4)]
    assert split.bisect([100, 100, 100, 100], [0, 3, 1, 1], 0)[0] == (0, 1)


def test_units_and_offsets():
    text = "First one. (b) Second two? not a cut! Third " + "x " * 300 + "end.\n\nLast"
    parts = split.units(text, 0)
    assert [text[a:b][:6] for a, b, _ in parts] == ["First ", "(b) Se", "Third ", "x x x ", "Last"]
    assert [n for _, _, n in parts] == [2, 6, 297, 5, 1]
    assert split.units("a b c", 500) == [(0, 1, 1), (2, 3, 1), (4, 5, 1)]
    assert split.tokens(0) == 1 and split.words_within(400) == 297 and split.words_within(60) == 45


def test_split_items(spark):
    types = "chunk_id string, text string, section_preamble string, overflow_chunks array<struct<chunk_id: string, text: string>>, whole string"
    body = " ".join(words(40) for _ in range(12))
    rows = [
        ("a", body, None, None, "x"), ("a", body, None, None, "y"), ("short", "Too short.", None, [], None), (None, body, None, [], None), ("none", None, "p", None, None), ("empty", "", None, [], None),
        ("o", words(200), words(60), [("o2", words(100)), ("o2", words(9)), ("o3", None), ("o4", ""), (None, words(5)), ("o", "again")], None),
    ]
    frame = spark.createDataFrame(rows, types)
    least = spark.createDataFrame([("l", " ".join("w" * 200), " ".join("p" * 98), None, None), ("k", " ".join("w" * 200), " ".join("p" * 97), None, None)], types)
    assert [r.chunk_id for r in split.oversized(least).collect()] == ["l"]  # 298 words of one letter
    whole = {r.chunk_id: r.whole for r in split.oversized(frame).collect()}
    assert set(whole) == {"a", "o"} and whole["o"] == " ".join([words(200), words(100), words(5)])
    for strategy in ("fill", "bisect"):
        pieces = split.split_items(split.oversized(frame), strategy).orderBy("chunk_id", "piece_no").collect()
        for p in pieces:
            assert whole[p.chunk_id][p.start_char : p.end_char] == p.piece and p.n_tokens <= 400
    filled = [(p.piece_no, p.start_char) for p in split.split_items(split.oversized(frame)).where("chunk_id = 'a'").collect()]
    step = len(words(40)) + 1
    assert sorted(filled) == [(1, 0), (2, 6 * step)]  # 7 sentences fit, the last one is repeated
    assert split.oversized(frame.limit(0)).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=300, deadline=None)
def test_best_fit_never_overfills(histogram):
    placed, opened = packing.best_fit(histogram, 64)
    sizes = [s for s in sorted(histogram, reverse=True) for _ in range(histogram[s])]
    load = [0] * opened
    ends = [p[0] for p in placed[1:]] + [len(sizes)]
    for (first, container), end in zip(placed, ends):
        for i in range(first, end):
            load[container + i - first] += sizes[i]
    assert all(0 < x <= 64 for x in load) and (not placed or placed[0][0] == 0)
    assert sum(x <= 32 for x in load) <= 1  # two half-empty containers would have been one


def test_pack_items(spark):
    choose = random.Random(5)
    rows = [(i, choose.choice([500, 500, choose.randint(1, 2000), choose.randint(2049, 9000)]), i, "x") for i in range(3000)] + [(5001, 0, 0, None), (5002, None, 0, None), (5003, 2048, 0, None), (7, 3, 1, None), (7, 3, 1, None)]
    packed = packing.pack_items(spark.createDataFrame(rows, "doc_id long, n_tokens long, container_id long, position string")).collect()
    loads, order = {}, {}
    for r in packed:
        if r.container_id is not None:
            loads[r.container_id] = loads.get(r.container_id, 0) + r.n_tokens
            order.setdefault(r.container_id, []).append(r.position)
    assert max(loads.values()) <= 2048 and all(sorted(p) == list(range(1, len(p) + 1)) for p in order.values())
    assert sorted(loads) == list(range(len(loads))) and sum(loads.values()) == sum(n or 0 for _, n, _, _ in rows)
    assert sum(loads.values()) / (2048 * len(loads)) > 0.97
    pieces = sorted((r.piece_no, r.token_from, r.n_tokens) for r in packed if r.doc_id == next(i for i, n, _, _ in rows if n > 4096))
    assert all(n == 2048 and f == 2048 * (p - 1) for p, f, n in pieces[:-1]) and len(pieces) > 2
    assert {r.doc_id for r in packed if r.container_id is None} == {5001, 5002} and sum(r.doc_id == 7 for r in packed) >= 3
    empty = packing.pack_items(spark.createDataFrame([], "doc_id long, n_tokens long"))
    assert empty.count() == 0 and packing.fill_report(empty).first().n_containers == 0


def test_token_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(packing.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("x", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world, it's 21 CFR § 1.1\n\nañadido", "", None, "x" * 100_000, "<|endoftext|>"]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "x", 0)], "doc_id long, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in packing.token_counts(rows).collect()} == {i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(texts)}
