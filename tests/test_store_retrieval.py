from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from statuta.operators import reports, retrieval, stats, store
from statuta.plans import analysis, pipeline, providers, questions
from statuta.sources import chunk_files, uploads
from statuta.streaming import events, ingest
from test_chunking import regulation, section


def pairs(spark, rows, names="point_id, content_hash"):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split(", ")))


def test_change_detection(spark):
    stored = pairs(spark, [("1", "h1"), ("2", "h2"), ("9", "h9"), (None, "x")])
    source = pairs(spark, [("1", "h1"), ("2", "h2x"), ("3", "h3"), ("4", None)])
    assert {r.point_id: r.action for r in store.changes(source, stored).collect()} == {"1": "skip", "2": "upsert", "3": "upsert", "4": "upsert"}
    assert [r.point_id for r in store.orphans(stored, source).collect()] == ["9"]
    assert tuple(store.duplicate_ids(pairs(spark, [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1"), (None, "1")]), "point_id").first()) == (1, 2)


def documents():
    long = "(b) " + " ".join(f"Sentence {i} has quite a few words in it." for i in range(120))
    return [regulation(section("101.1", "Rules", f"<P>(a) Milk under § 101.2 is fat.</P><P>{long}</P>") + section("101.2", "Definitions", "<P><E>Milk</E> means a drink.</P>"))]


def test_store_is_idempotent_and_versioned(spark, tmp_path):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "f0.xml").write_text(documents()[0])
    points = store.PointStore(spark, f"file://{tmp_path}/points")
    assert points.read() is None
    run = lambda: pipeline.ingest(spark, f"file://{tmp_path}/xml", f"file://{tmp_path}/chunks", points)
    first, second = run(), run()
    n = points.read().count()
    assert first["success"] and first["steps"][1]["result"] == {"upserted": n, "skipped_unchanged": 0, "deleted_orphans": 0}
    assert second["steps"][1]["result"] == {"upserted": 0, "skipped_unchanged": n, "deleted_orphans": 0}
    (tmp_path / "xml" / "f0.xml").write_text(regulation(section("101.2", "Definitions", "<P><E>Milk</E> means a liquid.</P>")))
    assert run()["steps"][1]["result"] == {"upserted": 1, "skipped_unchanged": 0, "deleted_orphans": n - 1} and points.read().count() == 1
    assert store.lookup(points.read(), "21-I-SCB-101-A-101-2-def-milk").count() == points.lookup("21-I-SCB-101-A-101-2-def-milk").count() == 1
    failed = pipeline.ingest(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/chunks", points)
    assert not failed["success"] and [s["status"] for s in failed["steps"]] == ["failed"]
    assert pipeline.ingest_status(False, []) == {"status": "no_run"} and pipeline.ingest_status(True, [failed])["status"] == "running"


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    points = store.PointStore(spark, f"file://{tmp_path}/points", buckets=10)
    rows = spark.createDataFrame([(f"p{i:03d}", f"c{i}", "paragraph" if i % 2 else None, f"text {i}") for i in range(100)], "point_id string, chunk_id string, chunk_type string, text string")
    assert points.ensure(rows.schema) and not points.ensure(rows.schema) and points.read().count() == 0
    assert points.apply(rows) == 10 and points.read().count() == 100
    before = points._manifest()["folders"]
    assert points.apply(rows.where("point_id = 'p007'").withColumn("text", F.lit("new"))) == 1
    after = points._manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and {r.text for r in points.read().where("point_id = 'p007'").collect()} == {"new"}
    assert points.apply(rows.limit(0), rows.where("chunk_type is null").select("point_id")) <= 10 and points.read().count() == 50
    assert points.apply(rows.limit(0)) == 0 and len(points._names("data")) <= 3
    assert "PartitionFilters: [isnotnull(chunk_type" in points.read().where("chunk_type = 'paragraph'")._jdf.queryExecution().executedPlan().toString()
    assert points.lookup("absent").count() == 0


def test_stream_of_chunk_files(spark, tmp_path):
    from statuta.operators.chunking import chunks
    from statuta.sources.regulation_xml import parse_elements

    found = chunks(parse_elements(spark.createDataFrame([("f.xml", bytearray(documents()[0].encode()))], "source_file string, content binary")))
    found.write.parquet(f"{tmp_path}/in")
    points = store.PointStore(spark, f"file://{tmp_path}/store")
    go = lambda: ingest.ingest_stream(spark, f"{tmp_path}/in", found.schema, points, f"{tmp_path}/cp", providers.encode, f"{tmp_path}/dead").awaitTermination()
    go()
    n = points.read().count()
    go()
    assert n == found.count() == points.read().count()


def test_fusion_and_ties(spark):
    ranks = lambda names: spark.createDataFrame([("q", x, i) for i, x in enumerate(names, 1)], "query_id string, id string, rank int")
    fused = retrieval.fuse(ranks("ABC"), ranks("CAD")).orderBy("fused_rank").collect()
    assert [(r.id, round(r.rrf_score, 6)) for r in fused] == [("A", 0.032522), ("C", 0.032266), ("B", 0.016129), ("D", 0.015873)]
    assert [r.id for r in retrieval.fuse(ranks("A"), ranks("B")).orderBy("fused_rank").collect()] == ["A", "B"]


def corpus(spark, n=150):
    rows = [(f"p{i:03d}", f"milk number {i} " + "fat " * (i % 5), "paragraph" if i % 2 else "definition", "101") for i in range(n)]
    return providers.encode(spark.createDataFrame(rows, "point_id string, text string, chunk_type string, part_number string"), "text")


def test_search_limits_and_filters(spark):
    points = corpus(spark)
    asked = providers.encode(spark.createDataFrame([("q1", "milk fat number 7"), ("q2", "")], "query_id string, query string"), "query").withColumnRenamed("dense", "vector")
    assert retrieval.search(points, asked, top_k=100).where("query_id = 'q1'").count() > 60
    reranked = retrieval.search(points, asked, top_k=100, use_reranker=True)
    assert reranked.where("query_id = 'q1'").count() == 10
    only = retrieval.search(points, asked, filters={"chunk_type": "definition", "part_number": None})
    assert {r.chunk_type for r in only.collect()} == {"definition"} and only.where("query_id = 'q2'").count() == 0
    assert retrieval.search(points, asked, top_k=0).where("query_id = 'q1'").count() == 20
    for bad in (-1, 101):
        with pytest.raises(ValueError):
            retrieval.search(points, asked, top_k=bad)
    with pytest.raises(ValueError):
        retrieval.predicate({"color": "red"})


def test_overflow_walk_is_forward_and_bounded(spark):
    rows = [(f"c{i}", f"t{i}", {"part": i + 1, "total_parts": 9, "next_chunk_id": f"c{i + 1}" if i < 8 else None}) for i in range(9)] + [("loop", "x", {"part": 1, "total_parts": 1, "next_chunk_id": "loop"}), ("lone", "y", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, overflow_sequence struct<part: int, total_parts: int, next_chunk_id: string>")
    hits = spark.createDataFrame([("q", "c0"), ("q", "c6"), ("q", "loop"), ("q", "lone")], "query_id string, chunk_id string")
    got = {r.chunk_id: [x.chunk_id for x in r.overflow_chunks] for r in retrieval.expand_overflow(hits, chunks).collect()}
    assert got == {"c0": ["c1", "c2", "c3", "c4", "c5"], "c6": ["c7", "c8"], "loop": ["loop"] * 5, "lone": []}
    chained = chunks.withColumn("text_no", F.when(F.col("chunk_id").startswith("c"), 1)).where("chunk_id <> 'c3'")
    got = {r.chunk_id: [x.chunk_id for x in r.overflow_chunks] for r in retrieval.expand_overflow(hits, chained, chain="text_no").collect()}
    assert got == {"c0": ["c1", "c2"], "c6": ["c7", "c8"], "loop": [], "lone": []}


def test_definitions_and_references(spark):
    hits = spark.createDataFrame([("q", "Milk", "a", "Cream", 1), ("q", "Milk", "b", "MILK", 2), ("q", "Milk", "c", "milk", 4), ("q", "Egg", "d", None, 1)], "query_id string, term string, chunk_id string, defines string, rank int")
    assert {r.term: (r.chunk_id, r.exact_match) for r in retrieval.definitions(hits).collect()} == {"Milk": ("b", True), "Egg": ("d", False)}
    chunks = spark.createDataFrame([("x", "1.1"), ("y", "1.1"), ("z", "1.2")], "chunk_id string, section_number string")
    retrieved = spark.createDataFrame([("q", "x", ["1.1", "1.2(a)", None])], "query_id string, chunk_id string, cross_references_internal array<string>")
    scored = spark.createDataFrame([("x", 1.0), ("y", 0.5), ("z", 0.1)], "chunk_id string, score double")
    found = lambda strip: sorted(r.chunk_id for r in retrieval.cross_references(retrieved, chunks, scored, strip_labels=strip).collect())
    assert found(False) == ["y"] and found(True) == ["y", "z"]


def test_reports(spark):
    rows = [("d", i, s, s) for i, s in enumerate(["low", "critical", "weird", "medium"])] + [("w", 1, "weird", "x")]
    findings = spark.createDataFrame(rows, "document_id string, seq int, severity string, text string")
    documents = spark.createDataFrame([("d", None), ("w", None), ("e", "bad"), ("n", None)], "document_id string, error string")
    got = {r.document_id: r for r in reports.severity_report(documents, findings).collect()}
    assert [f.severity for f in got["d"].findings] == ["critical", "medium", "low", "weird"] and got["d"].total == 4
    assert (got["d"].critical, got["d"].high, got["d"].medium, got["d"].low) == (1, 0, 1, 1)
    assert {k: r.overall_status for k, r in got.items()} == {"d": "non_compliant", "w": "compliant", "e": "error", "n": "compliant"}
    view = spark.createDataFrame([("x", 1, "high", "health_claim", "prohibited", "t", None, None)], "document_id string, seq int, severity string, claim_type string, violation_type string, claim_text string, explanation string, cfr_citation string")
    row = reports.finding_view(view).first()
    assert (row.id, row.title, row.severity) == ("v-1", "Prohibited Health Claim", "warning") and row.recommendation.startswith("Remove")
    counts = spark.createDataFrame([(1, 0, 1, 0, 0)], "total int, critical int, high int, medium int, low int")
    assert counts.select(reports.summary_line(F.lit("x.pdf"))).first()[0] == "Found 1 potential issue in x.pdf: 1 high-priority."


def test_answers_and_models():
    assert providers.parse_answer('see ```json {"a":1} ``` there') == {"a": 1}
    assert providers.parse_answer("no", lambda m: "[2]", [{}]) == [2]
    with pytest.raises(ValueError):
        providers.parse_answer("no")

    def broken(messages):
        raise RuntimeError("down")

    assert providers.chained([broken, lambda m: "x"])([]) == "x"
    with pytest.raises(RuntimeError):
        providers.chained([broken])([])


def test_uploads(spark):
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{uploads.WORD[1:-1]}"><w:p><w:t>Hello</w:t></w:p><w:p><w:t> </w:t></w:p><w:p><w:t>World</w:t></w:p></w:document>')
    files = [("a.docx", word.getvalue()), ("b.txt", b"\xe9t"), ("c.TXT", b"x" * 50_001), ("d", b""), ("e.doc", b"old"), ("f.docx", b"bad"), ("g.txt", b" \n "), ("h.txt", None)]
    rows = {r.document_name: r for r in uploads.read_uploads(spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in files], "document_name string, content binary")).collect()}
    assert rows["a.docx"].text == "Hello\nWorld" and rows["b.txt"].text == "ét"
    assert rows["c.TXT"].text == "x" * 50_000 + uploads.NOTICE
    assert all(rows[n].error and rows[n].text is None for n in ("d", "e.doc", "f.docx", "g.txt", "h.txt")) and len(rows) == 8


def test_questions_are_planned_at_most_twice(spark):
    points = corpus(spark, 30).withColumns({"section_number": F.lit("1.1"), "cfr_citation": F.col("point_id"), "section_preamble": F.lit(None).cast("string")})
    asked = spark.createDataFrame([("1", "what is milk fat number 7"), ("2", "ab")], "query_id string, query string")
    plans = []

    def plan(rows):
        plans.append(rows.count())
        return questions.plan_offline(rows)

    never = questions.Steps(plan=plan, verify=lambda rows: rows.withColumn("verification_passed", F.lit(False)))
    (row,) = questions.ask(asked, points, never).collect()
    assert plans == [1, 1] and row.retry_count == 2 and not row.verification_passed
    (row,) = questions.ask(asked, points).collect()
    assert row.verification_passed and row.retry_count == 0 and row.answer and len(row.retrieved_sections) == 10


def test_filters_of_a_question_apply_before_ranking(spark):
    rows = [(f"a{i:03d}", f"milk fat number {i}", "101", "101.1") for i in range(400)] + [(f"b{i}", "an unlike text on cheese", "102", f"102.{i}") for i in range(3)] + [("n", "milk", None, None)]
    points = providers.encode(spark.createDataFrame(rows, "point_id string, text string, part_number string, section_number string"), "text").withColumn("chunk_id", F.col("point_id"))
    asked = spark.createDataFrame([("1", "milk fat in part 102"), ("2", "milk fat in section 102.1"), ("3", "milk fat in part 101 and section 102.1"), ("4", "milk fat"), ("5", "milk fat cheese")], "query_id string, query string")
    planned = questions.plan_offline(asked)
    found = {}
    for r in questions.retrieve(planned, points).collect():
        found.setdefault(r.query_id, set()).add(r.chunk_id)
    assert found["1"] == {"b0", "b1", "b2"} and found["2"] == {"b1"} and "3" not in found and len(found["4"]) == len(found["5"]) == 10
    alone = retrieval.search(points, providers.encode(asked, "query").withColumnRenamed("dense", "vector").where("query_id = '4'"), top_k=10)
    assert {r.chunk_id for r in alone.collect()} == found["4"]


def test_scopes_give_the_same_rows_on_every_path(spark, monkeypatch):
    points = corpus(spark, 60).withColumn("scope", F.when(F.col("chunk_type") == "definition", "d").otherwise("p"))
    asked = providers.encode(spark.createDataFrame([("1", "milk number 7 fat", "d"), ("2", "milk fat", "p"), ("3", "milk fat", "none")], "query_id string, query string, scope string"), "query").withColumnRenamed("dense", "vector")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    both = lambda: (rows(retrieval.dense_search(points, asked, 5, scope=["scope"])), rows(retrieval.sparse_search(retrieval.terms(points, "point_id", also=["scope"]), retrieval.terms(asked, "query_id", "query", also=["scope"]).withColumnRenamed("id", "query_id"), 5, ["scope"])))
    by_matrix = both()
    alone = retrieval.dense_search(points.where("scope = 'd'"), asked.where("query_id = '1'"), 5)
    assert [r for r in by_matrix[0] if r[0] == "1"] == rows(alone) and len(by_matrix[0]) == len(by_matrix[1]) == 10
    monkeypatch.setattr(retrieval, "MOST_BROADCAST_QUERIES", 1)
    monkeypatch.setattr(retrieval, "MOST_BROADCAST_TERMS", 1)
    monkeypatch.setattr(retrieval, "MOST_SCORES", 1)
    assert both() == by_matrix


def test_an_answer_uses_ranks_parts_references_definitions_and_conflicts(spark):
    rows = [(f"p{i:02d}", f"milk fat label {'gold ' * (i == 19)}rule {i}", "paragraph", "1.1", None, [], None) for i in range(20)]
    rows += [
        ("start", "milk fat gold label shall be shown on standardized milk", "paragraph", "1.1", None, ["2.2", "9.9", None], ("next",)),
        ("next", "until the jar is empty", "overflow", "1.1", None, None, (None,)),
        ("deny", "milk fat gold label shall not be shown on standardized milk", "paragraph", "1.1", None, None, None),
        ("def", "Standardized milk means a drink.", "definition", "3.3", "Standardized Milk", None, None),
    ]
    rows += [(f"ref{i}", f"sodium limit {i}", "paragraph", "2.2", None, None, None) for i in range(5)]
    columns = "point_id string, text string, chunk_type string, section_number string, defines string, cross_references_internal array<string>, overflow_sequence struct<next_chunk_id: string>"
    points = providers.encode(spark.createDataFrame(rows, columns), "text").withColumns({"chunk_id": F.col("point_id"), "cfr_citation": F.col("point_id"), "part_number": F.lit("1"), "section_preamble": F.lit(None).cast("string")})
    asked = spark.createDataFrame([("1", "may a gold milk fat label be shown")], "query_id string, query string")
    seen = []

    def answer(rows):
        seen.append(rows.select("context").first()[0])
        return questions.answer_offline(rows)

    (row,) = questions.ask(asked, points, questions.Steps(answer=answer)).collect()
    assert set(row.retrieved_sections[:2]) == {"start", "deny"} and row.retrieved_sections[2] == "p19" and len(row.retrieved_sections) == 10
    assert [(d.term, d.chunk_id) for d in row.definitions] == [("Standardized Milk", "def")] and len(row.cross_ref_chunks) == 3 and all(c.startswith("ref") for c in row.cross_ref_chunks)
    assert row.conflicts_detected and {frozenset(c) for c in row.conflict_details} >= {frozenset(("start", "deny"))}
    assert seen[0].startswith("• Standardized Milk: ") and "milk until the jar is empty" in seen[0] and "[X3] ref" in seen[0] and "[X4]" not in seen[0]
    assert row.answer.startswith("milk fat gold label") and "[X1]" not in row.answer and row.verification_passed
    (row,) = questions.ask(asked, points, questions.Steps(judge=lambda a, b: F.lit(None).cast("boolean"), define=lambda r, p: questions.resolve_terms(r, p).limit(0))).collect()
    assert not row.conflicts_detected and row.conflict_details == row.definitions == []


def test_blocks_of_queries_give_the_same_neighbours(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(100, [nan, 1.0, 1.0]), (101, [inf, 1.0, 1.0]), (102, [0.0] * 3), (103, [1.0, 2.0]), (104, [1.0, None, 2.0]), (105, None), (106, [])]
    points = spark.createDataFrame(rows, "point_id long, dense array<double>")
    asked = points.select(F.col("point_id").alias("query_id"), F.col("dense").alias("vector"))
    asked = asked.unionByName(asked.where("query_id = 3"))  # a repeated query ranks once, in whatever blocks
    rows_of = lambda: sorted(map(tuple, retrieval.dense_search(points, asked, 5).collect()))
    one = rows_of()
    monkeypatch.setattr(retrieval, "MOST_BROADCAST_QUERIES", 7)
    assert rows_of() == one and {r[1] for r in one} <= {*range(40), 103} and {r[0] for r in one} == {*range(40), 103}


def test_a_task_hands_on_its_best_only(spark):
    points = spark.range(0, 5_000, 1, 4).select(F.col("id").alias("point_id"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("dense"))
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "query_id long, vector array<double>")
    scored = retrieval._partial_cosines(points.select(F.col("point_id").alias("id"), F.col("dense").alias("v")), asked.collect(), asked.schema, 5, [])
    assert scored.count() == 4 * 3 * 5
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.dense_search(points, asked, 5).collect()}
    assert [got[0, i] for i in range(1, 6)] == [6, 13, 20, 27, 34] and [got[1, i] for i in range(1, 6)] == [1, 8, 15, 22, 29]
    assert {r.term for r in retrieval.terms(spark.createDataFrame([("a", "§ 101.9(b) Año-nuevo")], "id string, text string"), "id").collect()} == {"101", "9", "b", "año", "nuevo"}


def test_result_columns(spark):
    hits = spark.createDataFrame([("q", 1, "c", 0.5, None, None, "9", [None, "1.1"])], "query_id string, rank int, chunk_id string, rrf_score double, reranker_score double, text string, part_number string, cross_references_internal array<string>")
    row = retrieval.results(hits).first()
    assert (row.score, row.text, row.cfr_citation, row.metadata.part_number, row.metadata.cross_references_internal, row.metadata.metrics) == (0.5, "", "", "9", [None, "1.1"], [])
    assert retrieval.compact(retrieval.results(hits)).first().asDict() == {"query_id": "q", "rank": 1, "chunk_id": "c", "text": "", "cfr_citation": "", "chunk_type": "", "section_preamble": None, "defines": None, "score": 0.5, "part_number": "9", "section_number": None}


def test_analysis(spark):
    points = corpus(spark, 30).withColumns({"chunk_id": F.col("point_id"), "cfr_citation": F.lit("21 CFR § 101.1")})
    documents = spark.createDataFrame([("d1", "Low sodium milk. Net weight 5 oz. Hello there.", None), ("d2", None, "empty")], "document_id string, text string, error string")
    judge = lambda kind, confidence: F.when(kind == "nutrition_fact", F.struct(F.lit("prohibited").alias("violation_type"), F.lit("critical").alias("severity")))
    got = {r.document_id: r for r in analysis.analyse(documents, points, judge, {"Ingredient list": "ingredients?:", "Net quantity": "net weight"}).collect()}
    assert (got["d1"].total, got["d1"].critical, got["d1"].high, got["d1"].overall_status) == (2, 1, 1, "non_compliant") and got["d2"].overall_status == "error"


def test_rules_read_whole_uploads(spark):
    filler = "Plain words. " * 5_000
    files = spark.createDataFrame([("a.txt", bytearray(f"{filler}Low sodium milk. Net weight 5 oz.".encode())), ("b.txt", bytearray(b" "))], "document_name string, content binary")
    rows = uploads.read_uploads(files).withColumnRenamed("document_name", "document_id")
    assert rows.where("document_id = 'a.txt'").select(F.length("full_text")).first()[0] > 65_000 and rows.where("full_text is null").count() == 1
    assert {r.claim_type for r in analysis.claims_offline(rows).collect()} == {"nutrition_fact", "net_weight"}
    assert [r.claim_text for r in analysis.gaps(rows, {"Net quantity": "net weight", "Ingredient list": "ingredients?:"}).collect()] == ["[Missing element] Ingredient list"]


def test_chunk_file_scan_and_statistics(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"total_chunks": 2, "chunks": [{"chunk_id": "a"}, {"chunk_id": "b"}]}')
    assert chunk_files.read_chunks(spark, str(tmp_path / "c.json"), "chunk_id string").count() == 2
    assert chunk_files.read_chunks(spark, str(tmp_path / "none.json"), "chunk_id string").count() == 0
    same = spark.createDataFrame([(3,), (3,), (None,)], "x int")
    assert [(r.bin, r.n) for r in stats.histogram(same, "x").collect()] == [(0, 2)] and stats.histogram(same.limit(0), "x").count() == 0


def test_event_streams_have_the_same_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:{10 + i}:00", i % 3, "view", 1.0) for i in range(20)]
    frame = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    frame.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/e")
    events.tumbling(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, events.tumbling(frame).collect()))
    assert events.sessions(frame).count() > 0 and events.last_states(frame).count() == 3
