"""The engine behind one object: ingest, search, questions, documents and jobs over a store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import regulatory as R
from statuta.operators import retrieval
from statuta.operators.store import PointStore
from statuta.plans import analysis, questions
from statuta.plans.jobs import Busy, JobTable, single_run
from statuta.plans.pipeline import ingest, ingest_status
from statuta.plans.providers import encode, overlap_score
from statuta.sources.uploads import read_uploads


class Engine:
    """Functions of the engine over the store in ``folder``; batches are DataFrames, single calls are batches of one."""

    def __init__(self, spark: SparkSession, folder: str, encoder: Callable[..., DataFrame] = encode, scorer: Callable[[Column, Column], Column] = overlap_score, steps: questions.Steps | None = None) -> None:
        self.spark, self.folder, self.encoder, self.scorer, self.steps = spark, folder.rstrip("/"), encoder, scorer, steps
        self.store, self.jobs = PointStore(spark, f"{self.folder}/points"), JobTable(spark, f"{self.folder}/jobs")
        self._runs: list[dict] = []
        self._running = False

    def health(self) -> dict:
        return {"status": "ok", "timestamp": datetime.now(UTC).isoformat()}

    def ingest(self, xml_folder: str, **options: bool) -> dict:
        """Run the pipeline; Busy if a run is in progress. The record of the run, with its run_id."""
        run_id = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
        with single_run(self.spark, self.folder):
            self._running = True
            try:
                record = {"run_id": run_id, **ingest(self.spark, xml_folder, f"{self.folder}/chunks", self.store, encoder=self.encoder, **options)}
            finally:
                self._running = False
        self._runs.append(record)
        return record

    def ingest_status(self) -> dict:
        return ingest_status(self._running, self._runs)

    def _points(self) -> DataFrame:
        points = self.store.read()
        if points is None:
            raise LookupError("nothing has been ingested")
        return points

    def search(self, query: str | DataFrame, top_k: int | None = 10, use_reranker: bool = True, **filters: str | None) -> DataFrame:
        """Results of a question or of a batch (query_id, query): a row per hit, in order of rank."""
        asked = self.spark.createDataFrame([("0", query)], "query_id string, query string") if isinstance(query, str) else query
        hits = retrieval.search(self._points(), self.encoder(asked, "query").withColumnRenamed("dense", "vector"), top_k, use_reranker, self.scorer, filters)
        return retrieval.results(retrieval.expand_overflow(hits, self._points()))

    def get_chunk(self, chunk_id: str) -> dict | None:
        found = self.store.lookup(chunk_id)
        row = found and found.first()
        return row.asDict(recursive=True) if row else None

    def query(self, question: str | DataFrame) -> DataFrame:
        """The answer to a question or the answers to a batch (query_id, query). ValueError for a single question that is too short."""
        if isinstance(question, str):
            if len(question) < questions.LEAST_CHARS:
                raise ValueError(f"a question has at least {questions.LEAST_CHARS} characters")
            question = self.spark.createDataFrame([("0", question)], "query_id string, query string")
        return questions.ask(question, self._points(), self.steps)

    def analyze_documents(self, files: DataFrame, judge: Callable[[Column, Column], Column], required: dict[str, str]) -> DataFrame:
        """A report per upload (document_name, content), those that cannot be read with their error."""
        documents = read_uploads(files).withColumnRenamed("document_name", "document_id")
        return analysis.analyse(documents, self._points(), judge, required)

    def analyze_document(self, name: str, content: bytes, judge: Callable[[Column, Column], Column], required: dict[str, str]) -> str:
        """Queue and run the analysis of one upload; the id of its job. An empty file is refused."""
        if not content:
            raise ValueError("the file is empty")
        job_id = self.jobs.submit()
        files = self.spark.createDataFrame([(name, bytearray(content))], "document_name string, content binary")
        self.jobs.run(job_id, lambda: self.analyze_documents(files, judge, required).first().asDict(recursive=True))
        return job_id

    def get_job(self, job_id: str) -> dict:
        return self.jobs.get(job_id)


def responses(results: DataFrame) -> DataFrame:
    """(query_id, total_results, results): the answer of a search per query, its hits in order of rank."""
    hit = F.struct(*[F.col(c) for c in ("rank", *[c for c in results.columns if c not in ("query_id", "rank")])])
    return results.groupBy("query_id").agg(F.count("*").alias("total_results"), F.array_sort(F.collect_list(hit), lambda a, b: a["rank"] - b["rank"]).alias("results"))


def status_label(status: Column, success: Column) -> Column:
    """running, no_run, ready, error or unknown, from a record's status and success."""
    return F.when(status.isin("running", "no_run", "unknown"), status).when(success, "ready").when(~success, "error").otherwise("unknown")


# What a reader is shown for the states of the index.
INDEX_LABELS = {"ready": "Data ready", "running": "Indexing…", "error": "Index error", "no_run": "Not indexed"}


def index_label(label: Column) -> Column:
    found = F.lit("")
    for name, shown in INDEX_LABELS.items():
        found = F.when(label == name, shown).otherwise(found)
    return found


def answer_badge(verified: Column, citations: Column) -> Column:
    """``Verified, 2 citations``."""
    return F.concat_ws(", ", F.when(F.coalesce(verified, F.lit(False)), "Verified").otherwise("Unverified"), R.counted(citations, "citation"))


def preview(spark: SparkSession, name: str) -> DataFrame:
    """One report row that says no analysis is connected, for callers without a store."""
    return spark.createDataFrame([(name, "needs_review", 0, "Preview: the file was received, but no analysis is connected.")], "document_id string, overall_status string, total int, summary string")


__all__ = ["Busy", "Engine", "answer_badge", "index_label", "preview", "responses", "status_label"]
