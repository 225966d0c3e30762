from __future__ import annotations

import numpy as np
import pytest

from statuta.llm import vectors

TYPES = "point_id string, cfr_dense array<float>, embedded_at timestamp, cid int, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], None, 1, "x") for i, v in rows], TYPES)


def brute(rows, k=5):
    ids = sorted(rows)
    x = np.array([np.float32(rows[i]) for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    return {i: [ids[j] for j in np.lexsort((np.arange(len(ids)), -s[n]))[:k]] for n, i in enumerate(ids)}, s


def test_transform_is_orthonormal():
    m = vectors.rotations(64, 2, 1)
    assert np.allclose(m[0] @ m[0].T, np.eye(64)) and not np.allclose(m[0], m[1])


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(0)
    rows = {f"p{c:02d}-{i:02d}": rng.normal(size=64) * 0.15 + centre for c, centre in enumerate(rng.normal(size=(40, 64))) for i in range(20)}
    rows |= {f"r{i:03d}": rng.normal(size=64) for i in range(200)}
    got = {}
    for r in vectors.most_similar(frame(spark, list(rows.items()))).collect():
        got.setdefault(r.point_id, []).append((r.rank, r.neighbour_id))
    truth, _ = brute(rows)
    near = [i for i in truth if i[0] == "p"]
    assert sum(len(set(truth[i]) & {n for _, n in got[i]}) for i in near) / (5 * len(near)) > 0.99
    assert sum(len(set(truth[i]) & {n for _, n in got.get(i, [])}) for i in truth) / (5 * len(truth)) > 0.9  # 200 of the rows have no near neighbours


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(1)
    v, w = rng.normal(size=64), rng.normal(size=64)
    rows = [(f"c{i:02d}", v) for i in range(12)] + [("s1", 2 * v), ("s0", 4 * v), ("w", w), ("zero", np.zeros(64)), ("short", v[:63]), ("nan", [float("nan"), *v[1:]]), ("inf", [float("inf"), *v[1:]]), ("none", None), (None, v)]
    rows += [("c00", v)]
    got = {}
    for r in vectors.most_similar(frame(spark, rows)).orderBy("point_id", "rank").collect():
        got.setdefault(r.point_id, []).append((r.neighbour_id, r.similarity))
    assert [n for n, _ in got["c00"]] == ["c01", "c02", "c03", "c04", "c05"] and [n for n, _ in got["c11"]] == ["c00", "c01", "c02", "c03", "c04"]
    assert [n for n, _ in got["s1"]] == ["c00", "c01", "c02", "c03", "c04"] and {s for _, s in got["s0"]} == {1.0}
    assert not {"zero", "short", "nan", "inf", "none"} & ({n for x in got.values() for n, _ in x} | set(got))
    pairs = vectors.similar_pairs(vectors.most_similar(frame(spark, rows))).collect()
    assert all(a < b for a, b in pairs) and len(set(pairs)) == len(pairs)
    assert vectors.most_similar(frame(spark, [])).count() == 0 and vectors.most_similar(frame(spark, [("a", v)])).count() == 0


def recall(spark, rows):
    got = {}
    for r in vectors.most_similar(frame(spark, list(rows.items()))).collect():
        got.setdefault(r.point_id, []).append((r.rank, r.neighbour_id, r.similarity))
    truth, values = brute(rows)
    assert all(len(x) == 5 and len({n for _, n, _ in x}) == 5 for x in got.values())
    return sum(len(set(truth[i]) & {n for _, n, _ in got.get(i, [])}) for i in truth) / (5 * len(truth))


def test_few_vectors_are_one_region_and_exact(spark):
    rng = np.random.default_rng(4)
    assert recall(spark, {f"p{i:03d}": rng.normal(size=64) for i in range(400)}) == 1


def test_crowded_regions_are_refined_and_large_ones_split(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = {f"p{i:03d}": np.ones(64) + rng.normal(size=64) * 0.02 for i in range(300)}  # all in one bucket of any table
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "REGION", 50)
    assert recall(spark, rows) == 1  # blocks that meet each other lose nothing
    monkeypatch.setattr(vectors, "CROWDED", 30)
    assert recall(spark, rows) > 0.9


def test_counts_are_exact(spark):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)], "cid long, vec array<float>").repartition(3)
    counts = vectors._counted(table, lambda unit: unit.argmax(1), 0)
    x = np.array([r.vec for r in table.collect()])
    assert counts == dict(zip(*map(lambda z: z.tolist(), np.unique(x.argmax(1), return_counts=True))))


@pytest.mark.parametrize("wide", [3, 64])
def test_other_widths(spark, wide):
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", rng.normal(size=wide)) for i in range(30)]
    assert vectors.most_similar(frame(spark, rows), wide).where("rank = 1").count() > 0
