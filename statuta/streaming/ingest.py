"""Incremental ingest of chunk tables as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from statuta.operators.store import PointStore


def ingest_stream(spark: SparkSession, folder: str, schema: str, store: PointStore, checkpoint: str, encode: Callable[[DataFrame], DataFrame], dead_letters: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Bring the store up to date with every new file; ends when all present files are done.

    Batches are at least once and keyed, so a repeated batch changes nothing. If the first batch
    fails the query fails; later ones that fail are written to ``dead_letters`` and the stream goes on.
    """
    done = {"any": False}

    def batch(rows: DataFrame, number: int) -> None:
        try:
            store.sync(rows, encode)
            done["any"] = True
        except Exception:
            if not done["any"]:
                raise
            rows.write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
