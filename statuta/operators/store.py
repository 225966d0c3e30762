"""The store of points: change detection, keyed upsert, orphan clean-up, lookup."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from statuta.functions import regulatory as R
from statuta.runtime import cut, scope


def payload(chunks: DataFrame, with_preamble: bool = True) -> DataFrame:
    """Chunks flattened to the store's columns, with point_id and the hash of the text that is embedded."""
    level = lambda name, key: F.col(f"hierarchy.{name}.{key}").alias(f"{name}_{key}")
    embedded = R.embed_text(F.col("hierarchy"), F.col("section_preamble"), F.col("text"), with_preamble)
    return chunks.select(
        R.point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", "chunk_type", "cfr_citation", level("title", "number"), level("chapter", "number"), level("part", "number"),
        level("subpart", "letter"), level("section", "number"), "source_file", "defines", F.coalesce("is_overflow_chunk", F.lit(False)).alias("is_overflow_chunk"), "text", "section_preamble",
        F.coalesce("cross_references_internal", F.expr("cast(array() as array<string>)")).alias("cross_references_internal"), "citations", "hierarchy", "overflow_sequence",
        embedded.alias("embed_text"), R.content_hash(embedded).alias("content_hash"),
    )


def last_write(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key: the last in ``order``. Rows with a null key are dropped.

    ``order`` should end in a unique column; fully equal rows are interchangeable.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys that occur more than once and how many rows are too many."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
    return counts.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_extra"))


def changes(source: DataFrame, stored: DataFrame, key: str = "point_id", hashed: str = "content_hash") -> DataFrame:
    """``source`` with ``action``: skip where the stored hash is equal, else upsert.

    Only key and hash of the store are read. A null hash on either side is never equal, so it is upserted.
    """
    known = stored.select(F.col(key).alias("_key"), F.col(hashed).alias("_hash")).where("_key is not null").groupBy("_key").agg(F.max("_hash").alias("_hash"))
    joined = source.join(known, source[key] == known["_key"], "left")
    return joined.withColumn("action", F.when(F.coalesce(F.col("_hash") == F.col(hashed), F.lit(False)), "skip").otherwise("upsert")).drop("_key", "_hash")


def orphans(stored: DataFrame, source: DataFrame, key: str = "point_id") -> DataFrame:
    """Keys of the store that the source no longer has."""
    return stored.select(key).where(F.col(key).isNotNull()).distinct().join(source.select(key), key, "left_anti")


def merged(stored: DataFrame, upserts: DataFrame, removed: DataFrame | None = None, key: str = "point_id") -> DataFrame:
    """The store after an upsert and a removal: untouched rows, then the new ones."""
    kept = stored.join(upserts.select(key), key, "left_anti")
    if removed is not None:
        kept = kept.join(removed.select(key), key, "left_anti")
    return kept.unionByName(upserts, allowMissingColumns=True)


def lookup(points: DataFrame, chunk_id: str) -> DataFrame:
    """The point of a chunk: at most one row; the filter reaches the scan."""
    return points.where(F.col("chunk_id") == chunk_id).limit(1)


class PointStore:
    """A table of points in a shared folder, in buckets by the hash of point_id.

    A write replaces only the buckets it touches: their new rows go to a new folder, and then a new
    manifest (one row per bucket, with the declared schema) names the folder of every bucket. Readers
    take the newest manifest, so they never see a half-written table, and a job that fails in
    between changes nothing. One writer at a time. Within a bucket rows are in folders by chunk_type
    and sorted by part and section, so filters on these skip files and row groups.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, within: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(within))) if self._fs.exists(self._path(within)) else []

    def _manifest(self, number: int | None = None) -> dict | None:
        """The newest manifest or the one of that number: schema, number of buckets, folder by bucket."""
        numbers = [int(n.split(".")[0]) for n in self._names("manifests") if n.endswith(".json")]
        if not numbers or (number is not None and number not in numbers):
            return None
        stream = self._fs.open(self._path(f"manifests/{max(numbers) if number is None else number:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Write under another name and rename, which is atomic; the manifest replaced stays for readers that have begun."""
        draft, final = self._path(f"manifests/draft-{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['number']:08d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer has published {final}")
        before = self._manifest(manifest["number"] - 1) or {"folders": {}}
        used = {f.split("/")[0] for m in (manifest, before) for f in m["folders"].values()}
        for name in self._names("data"):
            if name not in used:
                self._fs.delete(self._path(f"data/{name}"), True)

    def ensure(self, schema: StructType) -> bool:
        """Create the store with the declared schema if it is absent; whether it was."""
        if self._manifest() is not None:
            return False
        self._publish({"number": 1, "buckets": self.buckets, "schema": schema.jsonValue(), "folders": {}})
        return True

    def bucket(self, key: Column) -> Column:
        known = self._manifest()
        return F.pmod(F.xxhash64(key), F.lit(known["buckets"] if known else self.buckets)).cast("int")

    def read(self, buckets: set[int] | None = None) -> DataFrame | None:
        """The points, or those of some buckets; None if there is no store. Any other failure is raised."""
        manifest = self._manifest()
        if manifest is None:
            return None
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.folder}/data/{f}" for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType([*schema, StructField("write", StringType()), StructField("bucket", IntegerType())])).option("basePath", f"{self.folder}/data").parquet(*paths)
        return rows.select(*schema.names)

    def lookup(self, chunk_id: str) -> DataFrame | None:
        """The point of a chunk, from its bucket alone."""
        row = self.spark.range(1).select(self.bucket(R.point_id(F.lit(chunk_id)))).first()
        points = self.read({row[0]})
        return points and lookup(points, chunk_id)

    def apply(self, upserts: DataFrame, removed: DataFrame | None = None, retries: int = 3, base: float = 2.0) -> int:
        """Upsert rows and remove keys (point_id); the number of buckets rewritten. A failed write is tried again after base**attempt seconds."""
        upserts = upserts.withColumn("bucket", self.bucket(F.col("point_id")))
        gone = removed.select("point_id", self.bucket(F.col("point_id")).alias("bucket")) if removed is not None else None
        keys = upserts.select("bucket") if gone is None else upserts.select("bucket").unionByName(gone.select("bucket"))
        touched = {r[0] for r in keys.distinct().collect()}  # at most one row per bucket
        manifest = self._manifest() or {"number": 0, "buckets": self.buckets, "schema": upserts.drop("bucket").schema.jsonValue(), "folders": {}}
        stored = self.read(touched)
        rows = upserts if stored is None else merged(stored.withColumn("bucket", self.bucket(F.col("point_id"))), upserts, gone)
        if not touched:
            return 0
        schema = rows.drop("bucket").schema
        spread = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", *[c for c in ("chunk_type", "part_number", "section_number") if c in schema.names])
        for attempt in range(retries + 1):
            name = f"write={uuid.uuid4().hex}"
            try:
                spread.write.partitionBy("bucket", "chunk_type").parquet(f"{self.folder}/data/{name}")
                break
            except Exception:
                self._fs.delete(self._path(f"data/{name}"), True)
                if attempt == retries:
                    raise
                time.sleep(base**attempt)
        written = {int(n.split("=")[1]) for n in self._names(f"data/{name}") if n.startswith("bucket=")}
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched} | {str(b): f"{name}/bucket={b}" for b in written}
        self._publish({"number": manifest["number"] + 1, "buckets": manifest["buckets"], "schema": schema.jsonValue(), "folders": folders})
        return len(touched)

    def sync(self, chunks: DataFrame, encode, cleanup_orphans: bool = False) -> dict:
        """Bring the store up to date with ``chunks``; only changed chunks are encoded, only their buckets rewritten.

        ``encode`` adds vector columns to a DataFrame with embed_text. Of rows with one id the last
        of (source_file, section_seq, seq) counts, as with any later write. A second run with the
        same chunks upserts nothing, skips all and removes none.
        """
        with scope():
            order = [c for c in ("source_file", "section_seq", "seq") if c in chunks.columns]
            source = payload(last_write(chunks, "chunk_id", order))
            stored = self.read()
            marked = cut(source.withColumn("action", F.lit("upsert")) if stored is None else changes(source, stored), "marked")
            totals = {r["action"]: r["count"] for r in marked.groupBy("action").count().collect()}
            gone = cut(orphans(stored, marked), "gone") if stored is not None and cleanup_orphans else None
            n_gone = gone.count() if gone is not None else 0
            if totals.get("upsert") or n_gone or stored is None:
                fresh = encode(marked.where("action = 'upsert'").drop("action")).drop("embed_text")
                self.apply(fresh, gone)
        return {"upserted": totals.get("upsert", 0), "skipped_unchanged": totals.get("skip", 0), "deleted_orphans": n_gone}
