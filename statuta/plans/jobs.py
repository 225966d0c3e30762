"""Jobs as rows: an append-only table of state changes in a shared folder, and a lock so that one run goes at a time."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.runtime import exists

SCHEMA = "job_id string, seq int, status string, result string, error string, at timestamp"
#: States, and those that may follow each.
NEXT = {None: ("queued",), "queued": ("running", "failed"), "running": ("completed", "failed"), "completed": (), "failed": ()}


class Busy(RuntimeError):
    """Another run has the lock."""


@contextmanager
def single_run(spark: SparkSession, folder: str) -> Iterator[None]:
    """Holds the folder's lock; Busy if another run has it. The lock is a file, created atomically."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_running")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fs.create(path, False).close()
    except Exception as error:
        if fs.exists(path):
            raise Busy(f"a run is in progress: {path}") from error
        raise
    try:
        yield
    finally:
        fs.delete(path, False)


def current(changes: DataFrame) -> DataFrame:
    """The last change of every job."""
    return changes.where("job_id is not null").groupBy("job_id").agg(F.max_by(F.struct("seq", "status", "result", "error", "at"), "seq").alias("_x")).select("job_id", "_x.*")


class JobTable:
    """Jobs of one driver. Every change is a row; the state of a job is its last row."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._states: dict[str, tuple[int, str]] = {}

    def _append(self, job_id: str, status: str, result: object = None, error: str | None = None) -> None:
        seq, before = self._states.get(job_id, (0, None))
        if status not in NEXT[before]:
            raise ValueError(f"{status} cannot follow {before}")
        row = (job_id, seq + 1, status, None if result is None else json.dumps(result, ensure_ascii=False, default=str), error, datetime.now(UTC).replace(tzinfo=None))
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        self._states[job_id] = (seq + 1, status)

    def submit(self) -> str:
        """The id of a new job, queued."""
        job_id = str(uuid.uuid4())
        self._append(job_id, "queued")
        return job_id

    def run(self, job_id: str, work: Callable[[], object]) -> None:
        """Do the work of a queued job; its result or error is kept, and nothing is raised."""
        self._append(job_id, "running")
        try:
            result = work()
        except Exception as error:
            self._append(job_id, "failed", error=str(error) or type(error).__name__)
        else:
            self._append(job_id, "completed", result)

    def changes(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.folder) if exists(self.spark, self.folder) else self.spark.createDataFrame([], SCHEMA)

    def get(self, job_id: str) -> dict:
        """job_id, status, result and error; KeyError if there is no such job. The filter reaches the scan."""
        row = current(self.changes().where(F.col("job_id") == job_id)).first()
        if row is None:
            raise KeyError(job_id)
        return {"job_id": job_id, "status": row["status"], "result": None if row["result"] is None else json.loads(row["result"]), "error": row["error"]}

    def wait(self, job_id: str, attempts: int = 60, seconds: float = 2.0) -> dict:
        """``get``, asked again until the job has ended or the attempts are used up."""
        for attempt in range(attempts):
            job = self.get(job_id)
            if not NEXT[job["status"]] or attempt == attempts - 1:
                break
            time.sleep(seconds)
        return job
