"""What changed between full snapshots (problem 6).

Keys get persistent dense ordinals. Per snapshot and block of ordinals a compressed bitmap says which
keys are present, and a vector aligned with its ones holds a fingerprint of the compared columns.
Both are kept between runs, so a new delivery is encoded once and compared with the stored blocks of
the one before: AND-NOT of the bitmaps gives additions and removals, and the vectors show changes
among common keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.text import squeezed
from statuta.runtime import cut, exists, fresh_folder

#: Ordinals in a block: the unit of work and of a bitmap (1 KB before compression).
BLOCK = 1 << 13


def new_ordinals(keys: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(column, ordinal) of the distinct keys, not null, that ``known`` lacks: after its largest ordinal, in their order.

    Numbering is distributed: rows are range-partitioned and only one count per partition reaches
    the driver.
    """
    new = keys.select(column).where(F.col(column).isNotNull()).distinct()
    base = 0
    if known is not None:
        new = new.join(known, column, "left_anti")
        last = known.agg(F.max("ordinal")).first()[0]
        base = 0 if last is None else last + 1
    ranged = new.repartitionByRange(column).sortWithinPartitions(column)
    placed = cut(ranged.select(column, F.monotonically_increasing_id().alias("_at")), "ordinals")
    placed = placed.select(column, F.shiftright("_at", 33).alias("_part"), F.expr("_at & 8589934591").alias("_row"))
    start, offsets = base, []
    for part, rows in sorted(map(tuple, placed.groupBy("_part").count().collect())):  # one row per partition
        offsets.append((part, start))
        start += rows
    where = keys.sparkSession.createDataFrame(offsets, "_part long, _start long")
    return placed.join(F.broadcast(where), "_part").select(column, (F.col("_start") + F.col("_row")).alias("ordinal"))


def assign_ordinals(keys: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """Dictionary (column, ordinal) of ``known``, whose ordinals persist, and of the new keys."""
    numbered = new_ordinals(keys, column, known)
    return numbered if known is None else known.select(column, "ordinal").unionByName(numbered)


def pack(bits: np.ndarray) -> bytes:
    """A bitmap of ``BLOCK`` bits, compressed."""
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)).astype(bool)


def fingerprint(columns: list[Column]) -> Column:
    """Equal for rows whose columns are equal after whitespace is squeezed; null equals empty."""
    return F.xxhash64(*[squeezed(F.coalesce(c.cast("string"), F.lit(""))) for c in columns])


def encode_blocks(placed: DataFrame) -> DataFrame:
    """(snapshot, block, keys, bitmap, prints) of rows (snapshot, ordinal, print), at most ``BLOCK`` of them a block.

    prints holds the fingerprints of the keys present, in the order of their ordinals.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_slot")
        bits = np.zeros(BLOCK, bool)
        bits[rows["_slot"]] = True
        return pd.DataFrame({"snapshot": [rows["snapshot"].iloc[0]], "block": [rows["_block"].iloc[0]], "keys": [len(rows)], "bitmap": [pack(bits)], "prints": [rows["print"].to_numpy(np.int64).tobytes()]})

    blocks = placed.select("snapshot", F.floor(F.col("ordinal") / BLOCK).alias("_block"), (F.col("ordinal") % BLOCK).cast("int").alias("_slot"), "print")
    return blocks.groupBy("snapshot", "_block").applyInPandas(build, "snapshot int, block long, keys long, bitmap binary, prints binary")


def block_changes(before: tuple[bytes, bytes] | None, after: tuple[bytes, bytes] | None) -> list[tuple[str, np.ndarray]]:
    """(change_kind, slots) between the bitmaps and prints of one block in two snapshots; None is an absent block."""
    bits, prints = [], []
    for side in (before, after):
        present = np.zeros(BLOCK, bool) if side is None else unpack(side[0])
        aligned = np.zeros(BLOCK, np.int64)
        if side is not None:
            aligned[present] = np.frombuffer(side[1], np.int64)
        bits.append(present)
        prints.append(aligned)
    (old, new), differ = bits, prints[0] != prints[1]
    return [(kind, np.flatnonzero(x)) for kind, x in (("added", new & ~old), ("removed", old & ~new), ("changed", old & new & differ))]


class SnapshotIndex:
    """Ordinals and encoded deliveries in a shared folder, kept between runs. One writer at a time.

    A delivery whose number is there already is not read again; a number lower than the last is
    refused, since its successor has been compared. A delivery counts once its number is noted, last.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def numbers(self) -> list[int]:
        """Numbers of the deliveries encoded so far, in order."""
        steps = self._table("steps")
        return [] if steps is None else sorted(r[0] for r in steps.select("snapshot").distinct().collect())  # one per delivery

    def add(self, snapshots: DataFrame, key: str, compared: list[str], snapshot: str = "snapshot_no", loaded: str = "loaded_at") -> None:
        """Encode the deliveries that are new.

        Of several rows of a key in a delivery the one loaded last counts (of equals the one with the
        larger fingerprint). Rows whose key or snapshot is null are ignored, other columns play no part.
        """
        done = self.numbers()
        rows = snapshots.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull() & ~F.col(snapshot).cast("int").isin(done))
        newest = (
            rows.select(F.col(key).alias("_key"), F.col(snapshot).cast("int").alias("snapshot"), F.col(loaded).alias("_at"), fingerprint([F.col(c) for c in compared]).alias("_print"))
            .groupBy("_key", "snapshot")
            .agg(F.max(F.struct("_at", "_print")).alias("_last"))
            .select("_key", "snapshot", F.col("_last._print").alias("print"))
        )
        newest = cut(newest, "newest")
        fresh = sorted(r[0] for r in newest.select("snapshot").distinct().collect())  # one per delivery
        if not fresh:
            return
        if done and fresh[0] < done[-1]:
            raise ValueError(f"delivery {fresh[0]} comes after {done[-1]} has been compared")
        known = self._table("ordinals")
        new_ordinals(newest, "_key", known).write.mode("append").parquet(f"{self.folder}/ordinals")
        placed = newest.join(self._table("ordinals"), "_key").select("snapshot", "ordinal", "print")
        # A folder per delivery, replaced whole: a run that failed before its number was noted is done again.
        encode_blocks(placed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(f"{self.folder}/blocks")
        self.spark.createDataFrame([(n,) for n in fresh], "snapshot int").coalesce(1).write.mode("append").parquet(f"{self.folder}/steps")

    def changes(self, after: int | None = None) -> DataFrame:
        """(snapshot, _key, change_kind) against the delivery before, of all deliveries or those with larger numbers than ``after``."""
        numbers = self.numbers()
        steps = [(old, new) for old, new in zip(numbers, numbers[1:]) if after is None or new > after]
        if not steps:
            return self.spark.createDataFrame([], "snapshot int, _key string, change_kind string")
        blocks = self._table("blocks").select("snapshot", "block", F.struct("bitmap", "prints").alias("x"))
        follows = self.spark.createDataFrame(steps, "before int, step int")  # one row per delivery
        new = blocks.join(F.broadcast(follows), F.col("snapshot") == F.col("step")).select("step", "block", F.col("x").alias("after"))
        old = blocks.join(F.broadcast(follows), F.col("snapshot") == F.col("before")).select("step", "block", F.col("x").alias("before"))
        both = new.join(old, ["step", "block"], "full").select("step", "block", "before.bitmap", "before.prints", F.col("after.bitmap").alias("bitmap_after"), F.col("after.prints").alias("prints_after"))

        def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    sides = [None if x is None else (x, y) for x, y in ((row.bitmap, row.prints), (row.bitmap_after, row.prints_after))]
                    for kind, at in block_changes(*sides):
                        if len(at):
                            yield pd.DataFrame({"snapshot": np.int32(row.step), "ordinal": row.block * BLOCK + at, "change_kind": kind})

        changed = both.mapInPandas(diff, "snapshot int, ordinal long, change_kind string")
        return changed.join(self._table("ordinals"), "ordinal").select("snapshot", "_key", "change_kind")


def snapshot_changes(snapshots: DataFrame, key: str, compared: list[str], snapshot: str = "snapshot_no", loaded: str = "loaded_at", index: SnapshotIndex | None = None) -> DataFrame:
    """Rows (snapshot, key, change_kind): added, removed or changed against the delivery before.

    Deliveries are ordered by number and may have gaps. With ``index`` only its new deliveries are
    encoded, and what changed in them comes out; without, an index for this call is built. An empty
    table or a single delivery gives no rows; for nulls, repeated rows and ties see ``SnapshotIndex.add``.
    """
    index = index or SnapshotIndex(snapshots.sparkSession, fresh_folder(snapshots.sparkSession, "snapshots"))
    last = max(index.numbers(), default=None)
    index.add(snapshots, key, compared, snapshot, loaded)
    found = index.changes(last)
    return found.select(F.col("snapshot").alias(snapshot), F.col("_key").cast(snapshots.schema[key].dataType).alias(key), "change_kind")
