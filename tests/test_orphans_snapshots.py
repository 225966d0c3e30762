from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from statuta.operators import orphans, snapshots

DAY = datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + timedelta(days=n)


def targets(spark, files, sections):
    f = spark.createDataFrame([(n, day(a), day(b)) for n, a, b in files], "source_file string, registered_at timestamp, withdrawn_at timestamp")
    s = spark.createDataFrame([(t, n, x, day(a), day(b)) for t, n, x, a, b in sections], "title_number string, section_number string, source_file string, loaded_at timestamp, deleted_at timestamp")
    return orphans.regulation_targets(s, f)


def references(spark, rows):
    return spark.createDataFrame([(i, day(at), field, target, key) for i, at, field, target, key in rows], "result_id long, at timestamp, ref_field string, target string, ref_key string")


def test_direct_and_inherited(spark):
    known = targets(spark, [("A.xml", 0, 5), ("b.xml", 0, None)], [("21", "1.1", "x/A.XML", 1, None), ("21", "1.2", "gone.xml", 1, None), ("21", "1.3", "b.xml", 3, 6), ("21", "1.2", "gone.xml", 1, None), (None, "9.9", "b.xml", 1, None), ("21", "1.4", None, 1, None)])
    rows = references(spark, [(1, 2, "f", "sections", "21 1.1"), (2, 2, "f", "sections", "21 1.2"), (3, 2, "f", "sections", "21 1.3"), (4, 6, "f", "sections", "21 1.3"), (5, 4, "f", "sections", "21 1.3"), (6, 6, "f", "source_files", "a.xml"), (7, None, "f", "sections", "21 9.9"), (8, 2, "f", "sections", None), (9, 2, "f", "sections", "21 1.4"), (9, 2, "f", "sections", "21 9.9")])
    got = sorted((r.result_id, r.orphan_kind) for r in orphans.cascade(rows, known).collect())
    assert got == [(2, "inherited"), (3, "direct"), (4, "direct"), (6, "direct"), (9, "direct")]
    assert sorted(r.result_id for r in orphans.missing(rows, known).collect()) == [3, 4, 6, 9]
    report = {(r.target, r.orphan_kind): r.n_references for r in orphans.orphan_report(orphans.cascade(rows, known)).collect()}
    assert report == {("sections", "direct"): 3, ("sections", "inherited"): 1, ("source_files", "direct"): 1}
    assert orphans.cascade(rows.limit(0), known).count() == 0


def test_fixpoint_over_a_chain(spark):
    """Rows that refer to each other: the end of the chain is missing, so every row above is inherited."""
    rows = [(f"k{i}", f"k{i + 1}", day(0), None) for i in range(4)] + [("ok", None, day(0), None)]
    table = spark.createDataFrame(rows, "k string, ref string, since timestamp, until timestamp")
    known = {"t": orphans.Table(table, F.col("k"), "since", "until", "t", F.col("ref"))}
    asked = references(spark, [(i, 1, "f", "t", k) for i, k in enumerate(["k0", "k3", "k4", "ok"])])
    assert sorted((r.result_id, r.orphan_kind) for r in orphans.cascade(asked, known).collect()) == [(0, "inherited"), (1, "inherited"), (2, "direct")]


def test_lives_are_disjoint_spans(spark):
    known = targets(spark, [("a.xml", 0, 3), ("a.xml", 1, 2), ("a.xml", 3, 5), ("a.xml", 7, 7), ("a.xml", 8, None), ("a.xml", 8, 9), ("b.xml", None, 3)], [])
    (row,) = orphans.lifetimes(orphans.records(known["source_files"])).collect()
    assert sorted((x.since, x.until) for x in row.lives) == [(day(0), day(5)), (day(8), orphans.FOREVER)]
    rows = references(spark, [(i, i, "f", "source_files", "a.xml") for i in range(11)])
    assert sorted(r.result_id for r in orphans.missing(rows, known).collect()) == [5, 6, 7]


def test_keys(spark):
    cites = ["21 CFR § 101.13(a)", "21 C.F.R. 133.8 (b)", "16 cfr § 103.20(x)", "40 CFR Sec. 105.966 (definition: x)", "21 CFR §118.26b(a)", "Title 16", "n/a", "", None, "10 CFR § 105.1 [part 1 of 2]", "21 CFR part 101"]
    rows = spark.createDataFrame([(c,) for c in cites], "c string").select(orphans.citation_key(F.col("c")).alias("k"))
    assert [r.k for r in rows.collect()] == ["21 101.13", "21 133.8", "16 103.20", "40 105.966", "21 118.26b", None, None, None, None, "10 105.1", None]
    one = spark.range(1).select(orphans.section_key(F.lit(" 21 "), F.lit("§ 104.3b(a)(2)")).alias("a"), orphans.section_key(F.lit(None), F.lit("1.1")).alias("b"), orphans.file_stem(F.lit("/mnt/in/CFR-X.XML")).alias("c"), orphans.file_stem(F.lit("dir/")).alias("d")).first()
    assert tuple(one) == ("21 104.3b", None, "cfr-x.xml", None)


def brute(rows):
    last = {}
    for no, key, text, cite, at in rows:
        if key is not None and no is not None:
            plain = tuple(" ".join((x or "").split()) for x in (text, cite))
            if (no, key) not in last or at > last[no, key][0]:
                last[no, key] = (at, plain)
    numbers, found = sorted({n for n, _ in last}), set()
    for before, after in zip(numbers, numbers[1:]):
        old, new = ({k: v[1] for (n, k), v in last.items() if n == x} for x in (before, after))
        found |= {(after, k, "added") for k in new.keys() - old.keys()} | {(after, k, "removed") for k in old.keys() - new.keys()} | {(after, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return found


def test_snapshots_equal_brute_force(spark):
    choose = random.Random(4)
    texts = ["one two", "one\n two", "one two ", "three", "", None, "four " * 50_000]
    rows = [(choose.choice([1, 2, 3, 5, 6]), choose.choice([None, *[f"k{i}" for i in range(40)]]), choose.choice(texts), choose.choice(["a", "b", None]), DAY + timedelta(seconds=i)) for i in range(500)]
    rows += rows[:30]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "snapshot_no int, chunk_id string, text string, cfr_citation string, loaded_at timestamp, _key string, ordinal int")
    got = [tuple(r) for r in snapshots.snapshot_changes(frame, "chunk_id", ["text", "cfr_citation"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert snapshots.snapshot_changes(frame.limit(0), "chunk_id", ["text"]).count() == 0
    assert snapshots.snapshot_changes(frame.where("snapshot_no = 1"), "chunk_id", ["text"]).count() == 0


def test_ordinals_persist(spark):
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "k string")
    first = snapshots.assign_ordinals(keys("b", "a", "c", None, "a"), "k")
    assert {r.k: r.ordinal for r in first.collect()} == {"a": 0, "b": 1, "c": 2}
    again = snapshots.assign_ordinals(keys("0", "b", "d"), "k", first)
    assert {r.k: r.ordinal for r in again.collect()} == {"a": 0, "b": 1, "c": 2, "0": 3, "d": 4}
    one = snapshots.assign_ordinals(keys("b"), "k", snapshots.assign_ordinals(keys("a"), "k"))
    assert {r.k: r.ordinal for r in one.collect()} == {"a": 0, "b": 1}
    placed = again.select(F.lit(1).alias("snapshot"), "ordinal", F.col("ordinal").alias("print"))
    (row,) = snapshots.encode_blocks(placed).collect()
    assert row.keys == 5 and snapshots.unpack(bytes(row.bitmap))[:6].tolist() == [True] * 5 + [False]
    assert [(k, at.tolist()) for k, at in snapshots.block_changes((row.bitmap, row.prints), None)] == [("added", []), ("removed", [0, 1, 2, 3, 4]), ("changed", [])]


def test_an_index_compares_new_deliveries_with_stored_ones(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(no, k, t, DAY) for no, k, t in xs], "snapshot_no int, chunk_id string, text string, loaded_at timestamp")
    index = lambda: snapshots.SnapshotIndex(spark, f"file://{tmp_path}/index")
    got = lambda df: sorted(map(tuple, snapshots.snapshot_changes(df, "chunk_id", ["text"], index=index()).collect()))
    assert got(rows((1, "a", "x"), (1, "b", "y"), (1, "b", "y"))) == []
    assert got(rows((1, "zz", "not read again"), (3, "a", "x2"), (3, "c", "z"))) == [(3, "a", "changed"), (3, "b", "removed"), (3, "c", "added")]
    assert got(rows((3, "a", "other"), (4, "b", "y"), (4, "c", "z"), (4, None, "n"), (None, "q", "n"))) == [(4, "a", "removed"), (4, "b", "added")]
    assert got(rows((4, "b", "y"))) == [] and sorted(map(tuple, index().changes().collect()))[-1] == (4, "b", "added")
    assert {r._key: r.ordinal for r in index()._table("ordinals").collect()} == {"a": 0, "b": 1, "c": 2}
    try:
        got(rows((2, "a", "late")))
    except ValueError:
        pass
    else:
        raise AssertionError("a late delivery must be refused")
