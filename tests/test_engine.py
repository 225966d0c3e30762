from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from statuta import settings
from statuta.functions import regulatory as R
from statuta.plans import analysis, api, jobs, providers, questions
from statuta.sources import chunk_files
from statuta.streaming import events
from test_store_retrieval import corpus, documents


def test_settings():
    made = settings.Settings.from_env({"STATUTA_STORE": " s3://b/x/ ", "STATUTA_KEY_B": "k", "STATUTA_MODEL_B": "b/large", "STATUTA_KEY_A": "k", "STATUTA_KEY_C": " ", "STATUTA_ORIGINS": "http://a/, ,http://a,http://b//"})
    assert made == settings.Settings("s3://b/x", ("a/default", "b/large", settings.LOCAL_MODEL), ("http://localhost:3000", "http://a", "http://b"), "local")
    assert settings.Settings.from_env({"STATUTA_SITE": "https://x.org/"}).environment == "cloud"


def test_engine_from_ingest_to_report(spark, tmp_path):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "f0.xml").write_text(documents()[0])
    engine = api.Engine(spark, f"file://{tmp_path}/engine")
    assert engine.health()["status"] == "ok" and engine.ingest_status() == {"status": "no_run"}
    with pytest.raises(LookupError):
        engine.search("milk")
    run = engine.ingest(f"file://{tmp_path}/xml")
    assert run["success"] and engine.ingest_status() == run
    with jobs.single_run(spark, engine.folder), pytest.raises(jobs.Busy):
        engine.ingest(f"file://{tmp_path}/xml")
    found = engine.search("milk fat", top_k=3, part_number="101")
    first = found.orderBy("rank").first()
    assert found.count() == 3 and first.metadata.part_number == "101" and first.reranker_score is not None
    assert engine.search("milk", part_number="999").count() == 0
    (row,) = api.responses(found).collect()
    assert row.total_results == 3 and [r["rank"] for r in row.results] == [1, 2, 3]
    assert engine.get_chunk(first.chunk_id)["chunk_id"] == first.chunk_id and engine.get_chunk("none") is None
    assert engine.query("what is milk fat?").count() == 1
    with pytest.raises(ValueError):
        engine.query("milk")
    judge = lambda kind, confidence: F.struct(F.lit("incorrect").alias("violation_type"), F.lit("low").alias("severity"), (kind == "net_weight").alias("compliant"))
    job = engine.analyze_document("a.txt", b"Low sodium milk. Net weight 5 oz.", judge, {"Net quantity": "net weight"})
    report = engine.jobs.wait(job, attempts=1)
    assert report["status"] == "completed" and report["result"]["total"] == 1 and report["result"]["overall_status"] == "partially_compliant"
    with pytest.raises(ValueError):
        engine.analyze_document("a.txt", b"", judge, {})
    with pytest.raises(KeyError):
        engine.get_job("none")
    assert api.preview(spark, "x").first().overall_status == "needs_review"


def test_jobs_follow_their_states(spark, tmp_path):
    table = jobs.JobTable(spark, f"file://{tmp_path}/jobs")
    first, second = table.submit(), table.submit()
    table.run(first, lambda: {"é": 1})
    table.run(second, lambda: 1 / 0)
    assert table.get(first) == {"job_id": first, "status": "completed", "result": {"é": 1}, "error": None} and table.get(second)["error"] == "division by zero"
    with pytest.raises(ValueError):
        table.run(first, lambda: 1)
    assert jobs.current(table.changes()).count() == 2 and table.changes().count() == 6


def test_states_are_kept_between_batches_of_a_stream(spark, tmp_path):
    rows = [(1, "a", "queued"), (2, "a", "completed"), (3, "b", "running"), (4, None, "queued")], [(5, "a", "running"), (6, "a", "completed"), (7, "b", "queued")]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("event_id long, user_id string, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    allowed = {k: v for k, v in jobs.NEXT.items() if k}
    for batch in rows:
        spark.createDataFrame(batch, "event_id long, user_id string, event_type string").withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = {}
        out = events.state_changes(stream, allowed, jobs.NEXT[None]).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp")
        out.foreachBatch(lambda df, n: found.update({r.key: (r.state, r.n_applied, r.n_refused) for r in df.collect()})).trigger(availableNow=True).start().awaitTermination()
    assert found == {"a": ("completed", 3, 1), "b": ("queued", 1, 1)}


def test_one_file_with_an_envelope(spark, tmp_path):
    rows = spark.createDataFrame([("b", "f2", None), ("a", "f1", "§ é")], "chunk_id string, source_file string, text string")
    chunk_files.write_envelope(rows, f"{tmp_path}/one")
    text = "".join(p.read_text() for p in (tmp_path / "one").glob("part-*"))
    made = json.loads(text)
    assert made["total_chunks"] == 2 and made["source_files"] == ["f1", "f2"] and [c["chunk_id"] for c in made["chunks"]] == ["a", "b"] and made["chunks"][1]["text"] is None and "§ é" in text
    assert chunk_files.read_chunks(spark, f"{tmp_path}/one", "chunk_id string, text string").count() == 2
    chunk_files.write_envelope(rows.limit(0), f"{tmp_path}/none")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*")))["chunks"] == []
    with pytest.raises(ValueError):
        chunk_files.write_envelope(rows, f"{tmp_path}/two", most=1)


def test_models(spark):
    seen = []

    def old(messages, json_mode):
        seen.append(json_mode)
        if json_mode:
            raise RuntimeError("no such mode")
        return "{}"

    assert providers.chained_json([old])([]) == "{}" and seen == [True, False]
    score = lambda pairs: [float(len(text.split())) for _, text in pairs]
    rows = spark.createDataFrame([("a b", "x " * 600), ("a", None), (None, "y z")], "query string, text string")
    raw = providers.batch_scorer(score, normalize=False)
    assert [r[0] for r in rows.select(raw(F.col("query"), F.col("text"))).collect()] == [510.0, 0.0, 2.0]
    assert 0.5 < rows.where("query is null").select(providers.batch_scorer(score)(F.col("query"), F.col("text"))).first()[0] < 1
    both = {r.k: r for r in providers.encode_batch(spark.createDataFrame([(1, "milk Milk fat"), (2, ""), (3, None)], "k int, embed_text string"), "k").collect()}
    assert sorted(both[1].sparse.values()) == [1.0, 2.0] and both[2].sparse is None and len(both[3].dense) == providers.WIDE
    loads = []
    load = lambda: loads.append(1) or "model"
    assert providers.per_worker("x", load) == providers.per_worker("x", load) == "model" and loads == [1]


def test_a_second_plan_has_the_issues_of_the_first(spark):
    points = corpus(spark, 20).withColumns({"section_number": F.lit("1.1"), "cfr_citation": F.col("point_id"), "section_preamble": F.lit(None).cast("string")})
    asked, plans, seen = spark.createDataFrame([("1", "what is milk fat")], "query_id string, query string"), [], []

    def plan(rows):
        planned = questions.plan_offline(rows)
        plans.append(planned.select("sub_questions").first()[0])
        return planned

    def verify(rows):
        seen.append(rows.select("evidence").first()[0])
        return rows.withColumns({"verification_passed": F.lit(False), "verification_issues": F.array(F.lit("number 7"))})

    (row,) = questions.ask(asked, points, questions.Steps(plan=plan, verify=verify, answer=lambda rows: rows.withColumns({"draft_answer": F.lit(None).cast("string"), "citations": F.array(F.lit("x")), "confidence_score": F.lit(0.9)}))).collect()
    assert plans == [["what is milk fat"], ["what is milk fat", "what is milk fat number 7"]] and row.retry_count == 2
    assert (row.answer, row.citations, row.confidence_score) == (questions.NO_ANSWER, [], 0.0)
    assert seen[0].startswith("[p") and seen[0].count("\n---\n") == 9
    chapter = questions.plan_offline(spark.createDataFrame([("1", "rules of Chapter IV?")], "query_id string, query string")).first()
    assert chapter.filter_chapter == "IV"


def test_a_filter_may_leave_one_point_of_many(spark):
    points = providers.encode(spark.range(0, 20_000, 1, 4).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("point_id"), F.when(F.col("id") == 17, "cheese").otherwise("milk fat in part").alias("text"), F.when(F.col("id") == 17, "2").otherwise("1").alias("part_number")), "text").withColumns({"section_number": F.lit("1.1"), "chunk_id": F.col("point_id")})
    planned = questions.plan_offline(spark.createDataFrame([("1", "milk fat in part 2?")], "query_id string, query string"))
    assert [r.chunk_id for r in questions.retrieve(planned, points).collect()] == ["p17"]


def test_contexts_leave_out_chunks_without_text(spark):
    kind = "document_id string, top_chunks array<struct<rank: int, chunk_id: string, cfr_citation: string, text: string, score: double, reranker_score: double>>"
    chunks = [(i, f"c{i}", None if i == 2 else f"s{i}", text, 0.1, None) for i, text in enumerate(["a" * 700, "", "b", "never"])]
    rows = {r.document_id: r.context for r in analysis.claim_context(spark.createDataFrame([("d", chunks), ("e", None)], kind)).collect()}
    assert rows == {"d": f"[s0]\n{'a' * 600}\n\n[]\nb", "e": "No relevant sections found."}
    retrieved = spark.createDataFrame([("q", 0, 1, "s", None, None, []), ("q", 0, 2, "t", None, "text", [])], "query_id string, sq int, rank int, cfr_citation string, section_preamble string, text string, overflow_chunks array<struct<chunk_id: string, text: string>>")
    (row,) = questions.context(retrieved).collect()
    assert row.context == "[1] t\ntext" and row.retrieved_sections == ["s", "t"]


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert get(R.csv_items(lit(" a/ ,,b,a"))) == ["a", "b"] and get(R.csv_items(lit(None).cast("string"))) == []
    assert get(R.prefixed(lit("x"), "p")) == get(R.prefixed(lit("p/x"), "p")) == "p/x"
    assert get(R.json_list(lit('{"a": 1}'))) == [] and get(R.json_list(lit("[1, 2]"), "int")) == [1, 2] and get(R.json_list(lit("[broken"))) == []
    assert get(R.whole_text(lit("a"), F.array(F.struct(lit("x").alias("chunk_id"), lit("b").alias("text"))))) == "a b"
    assert tuple(get(R.sparse_arrays(F.create_map(lit(5), lit(1.0), lit(2), lit(3.0))))) == ([2, 5], [3.0, 1.0])
    assert get(api.index_label(api.status_label(lit(None).cast("string"), lit(True)))) == "Data ready" and get(api.status_label(lit("odd"), lit(None).cast("boolean"))) == "unknown"
    assert get(api.answer_badge(lit(None).cast("boolean"), lit(1))) == "Unverified, 1 citation"
    assert get(R.snake_to_title(lit("a_" + "b" * 3))) == "A Bbb"
