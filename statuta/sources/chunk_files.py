"""Chunk files: one JSON envelope with all chunks, and chunk tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.runtime import exists


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The chunks of envelopes {generated_at, total_chunks, source_files, chunks}; none if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"chunks array<struct<{schema}>>").option("multiLine", True).json(path)
    return rows.select(F.explode("chunks").alias("c")).select("c.*")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as a Parquet table by kind, and beside it one row about the run as JSON.

    A single file with all chunks would pass through one task; the table takes its place.
    """
    chunks.write.mode("overwrite").partitionBy("chunk_type").parquet(path)
    about = chunks.agg(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.count("*").alias("total_chunks"), F.array_sort(F.collect_set("source_file")).alias("source_files"))
    about.write.mode("overwrite").json(f"{path}-run")


def write_envelope(chunks: DataFrame, path: str, order: tuple[str, ...] = ("chunk_id",), most: int = 1_000_000) -> None:
    """One JSON text {generated_at, total_chunks, source_files, chunks}, for readers that need a single file.

    Its lines pass through one task, so more than ``most`` chunks are refused; ``write_chunks`` has no bound.
    """
    about = chunks.agg(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.count("*").alias("total_chunks"), F.array_sort(F.collect_set("source_file")).alias("source_files")).first()
    if about["total_chunks"] > most:
        raise ValueError(f"{about['total_chunks']} chunks; write_chunks has no bound")
    head = json.dumps({k: about[k] for k in ("generated_at", "total_chunks", "source_files")}, ensure_ascii=False)[:-1] + ', "chunks": ['
    place = F.row_number().over(Window.orderBy(*order))
    lines = chunks.select(place.alias("n"), F.to_json(F.struct(*chunks.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines = lines.select("n", F.concat("value", F.when(F.col("n") < about["total_chunks"], ",").otherwise("")).alias("value"))
    ends = chunks.sparkSession.createDataFrame([(0, head), (about["total_chunks"] + 1, "]}")], "n int, value string")
    lines.unionByName(ends).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_file").agg(F.count("*").alias("n_chunks"))
