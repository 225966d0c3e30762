from __future__ import annotations

import random
from collections import Counter

import pytest

from statuta.llm import neardup

TYPES = "chunk_id string, text string, defines string, cid long, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], TYPES)


def key(term):
    plain = "".join(c for c in (term or "").lower() if not c.isspace() and c != "-")
    return plain or None


def brute(rows, t=0.7):
    sets = {i: (set(x.lower().split()), key(d)) for i, x, d in rows if i and x and len(x.split()) >= 12}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a][0] & sets[b][0]) * 10 >= t * 10 * len(sets[a][0] | sets[b][0]) - 1e-9 and (None in (sets[a][1], sets[b][1]) or sets[a][1] == sets[b][1])}


def corpus(seed, n=260):
    choose = random.Random(seed)
    common, rare, rows = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(3000)], []
    while len(rows) < n:
        base = choose.sample(common, choose.randint(5, 25)) + choose.sample(rare, choose.randint(4, 30))
        for _ in range(choose.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(choose.randint(0, 8)):
                k = choose.randrange(len(text))
                choice = choose.random()
                if choice < 0.4:
                    text[k] = choose.choice(rare)
                elif choice < 0.7:
                    text.insert(k, choose.choice(common))
                elif len(text) > 1:
                    text.pop(k)
            choose.shuffle(text)
            rows.append((f"k{len(rows):04d}", " ".join(text), choose.choice([None, None, "A-b", "a B", "c", " "])))
    return rows


@pytest.mark.parametrize("seed,region", [(1, 20_000), (2, 7), (3, 20_000)])
def test_equal_to_brute_force(spark, monkeypatch, seed, region):
    monkeypatch.setattr(neardup, "REGION", region)
    rows = corpus(seed)
    members, pairs = neardup.near_duplicates(frame(spark, rows))
    got = [tuple(r) for r in neardup.chunk_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 50
    links = {r.chunk_id: r.n_links for r in neardup.linked_members(members, pairs).collect()}
    assert {k: n for k, n in links.items() if n} == Counter(x for pair in got for x in pair)


def test_exact_threshold_and_long_texts(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [("a", " ".join(base), None), ("b", " ".join(base[:70]), None), ("c", " ".join(base[:69]), None), ("d", " ".join(f"v{i}" for i in range(20_000)), None), ("e", " ".join(f"v{i}" for i in range(3, 20_500)), None)]
    got = {tuple(r) for r in neardup.chunk_pairs(*neardup.near_duplicates(frame(spark, rows))).collect()}
    assert got == {("a", "b"), ("b", "c"), ("d", "e")}


def test_copies_nulls_and_empty(spark):
    text = "One two three four five six seven eight nine ten eleven twelve"
    rows = [("x", text, None), ("y", text.upper() + "!", None), ("y", text.upper() + "!", None), ("z", text + " twelve", "T"), ("u", text, "S"), (None, text, None), ("n", None, None), ("e", "", None), ("s", "one two", None), ("p", "... !!", None)]
    members, pairs = neardup.near_duplicates(frame(spark, rows))
    assert {tuple(r) for r in neardup.chunk_pairs(members, pairs).collect()} == {("x", "y"), ("u", "x"), ("u", "y"), ("x", "z"), ("y", "z")}
    listed = {r.chunk_id: (r.class_id, r.n_copies, r.n_links) for r in neardup.linked_members(members, pairs).collect()}
    assert listed == {i: ("u", 4, n) for i, n in zip("xyzu", (3, 3, 2, 2))}
    members, pairs = neardup.near_duplicates(frame(spark, []))
    assert neardup.chunk_pairs(members, pairs).count() == 0 and neardup.linked_members(members, pairs).count() == 0
