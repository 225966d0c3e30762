"""The ingest run: extract, then embed, with a record of its steps."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from statuta.operators.chunking import chunks
from statuta.operators.store import PointStore
from statuta.plans.providers import encode
from statuta.runtime import exists
from statuta.sources.chunk_files import write_chunks
from statuta.sources.regulation_xml import read_regulations


@dataclass
class Step:
    name: str
    status: str = "pending"
    result: dict = field(default_factory=dict)
    error: str | None = None
    duration_seconds: float = 0.0


@dataclass
class Run:
    started_at: str
    steps: list[Step] = field(default_factory=list)
    success: bool = True
    completed_at: str | None = None

    def record(self) -> dict:
        rows = [s.__dict__ | {"duration_seconds": round(s.duration_seconds, 2)} for s in self.steps]
        return {"started_at": self.started_at, "completed_at": self.completed_at, "success": self.success, "steps": rows}


def _do(run: Run, name: str, work: Callable[[], dict] | None) -> Step:
    """Run a step and record it; None means that it is skipped."""
    step = Step(name)
    run.steps.append(step)
    if work is None:
        step.status = "skipped"
        return step
    began = time.monotonic()
    try:
        step.result, step.status = work(), "done"
    except Exception as error:
        step.status, step.error, run.success = "failed", str(error), False
    step.duration_seconds = time.monotonic() - began
    return step


def ingest(spark: SparkSession, xml_folder: str, chunk_table: str, store: PointStore, run_extract: bool = True, run_embed: bool = True, skip_if_exists: bool = False, encoder: Callable[[DataFrame], DataFrame] = encode) -> dict:
    """Extract and embed; the record of the run.

    A failed extraction ends the run. Orphans are removed only if this run extracted the chunks,
    so that an old table never deletes newer points.
    """
    run = Run(datetime.now(UTC).isoformat())

    def extract() -> dict:
        write_chunks(chunks(read_regulations(spark, xml_folder)), chunk_table)
        return {"total_chunks": spark.read.parquet(chunk_table).count()}

    step = _do(run, "extract", None if not run_extract or (skip_if_exists and exists(spark, chunk_table)) else extract)
    if step.status != "failed":
        _do(run, "embed", (lambda: store.sync(spark.read.parquet(chunk_table), encoder, step.status == "done")) if run_embed else None)
    run.completed_at = datetime.now(UTC).isoformat()
    return run.record()


def ingest_status(running: bool, runs: list[dict]) -> dict:
    """running, no_run, or the last run's record."""
    return {"status": "running"} if running else runs[-1] if runs else {"status": "no_run"}
