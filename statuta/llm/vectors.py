"""Most similar vectors for every vector (problem 2), by multiprobe cross-polytope hashing.

Unit vectors go through pseudo-rotations (three rounds of random signs and a fast Hadamard
transform); a hash value is the nearest signed axis. All vectors are one region; a region that is
crowded is refined by the next hash value, so dense regions do not become one task and sparse ones
keep their neighbours. Each vector goes to its own region and probes those behind its least certain
axes. In every region all vectors meet: candidates by products in single precision with a margin,
then exact cosines in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.runs import sorted_runs
from statuta.runtime import cut, salt

#: Tables, and regions that each vector goes to in a table. At an equal number of copies one table with more
#: probes found more neighbours than several with fewer (see README).
TABLES, PLACES = 1, 4
#: Axes of the hash value that refines a region of each depth: 128 parts of 64-wide vectors, then 16 of each.
AXES = (1 << 30, 8, 8, 8)
#: Vectors at home in a region beyond which it is refined, and rows (guests too) beyond which one that is not
#: refined any more is split into blocks that meet each other.
CROWDED, REGION = 2048, 16_384
#: Rows of a region that are compared with all others at once.
BLOCK = 1024
#: More than the error of a product of unit vectors in single precision.
MARGIN = 2e-6
WAYS = 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast orthonormal Hadamard transform of the rows of ``x`` (a power of two wide)."""
    n, wide, step = len(x), x.shape[1], 1
    while step < wide:
        y = x.reshape(n, wide // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, wide)
        step *= 2
    return x / np.sqrt(wide)


def rotations(wide: int, count: int, seed: int) -> np.ndarray:
    """``count`` pseudo-rotations as matrices: the transform applied to the unit vectors once."""
    signs, found = np.random.default_rng(seed), []
    for _ in range(count):
        m = np.eye(wide)
        for _ in range(3):
            m = hadamard(m * signs.choice([-1.0, 1.0], wide))
        found.append(m)
    return np.stack(found)


class Hasher:
    """Regions of unit vectors in the tree of hash values."""

    def __init__(self, wide: int, seed: int = 7) -> None:
        self.padded = 1 << (wide - 1).bit_length()
        self.axes = [min(a, self.padded) for a in AXES]
        self.radix = 2 * self.padded
        self.matrices = rotations(self.padded, TABLES * len(AXES), seed).reshape(TABLES, len(AXES), self.padded, self.padded)

    def values(self, unit: np.ndarray, table: int, depth: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest signed axes of every vector, nearest first, and how much farther each is than the first."""
        if unit.shape[1] < self.padded:
            unit = np.pad(unit, ((0, 0), (0, self.padded - unit.shape[1])))
        y = unit @ self.matrices[table, depth][:, : self.axes[depth]]
        size = np.abs(y)
        near = np.argsort(-size, axis=1, kind="stable")[:, :most]
        size = np.take_along_axis(size, near, 1)
        return 2 * near + (np.take_along_axis(y, near, 1) < 0), size[:, :1] - size

    def homes(self, unit: np.ndarray, table: int) -> Iterator[np.ndarray]:
        """Each vector's own region at every depth that may be refined, the root first."""
        key = np.full(len(unit), table + 1, np.int64)
        for depth in range(len(AXES)):
            yield key
            key = key * self.radix + self.values(unit, table, depth, 1)[0][:, 0]

    def places(self, unit: np.ndarray, table: int, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, keys) of the unrefined regions each vector goes to: its own and the least far others."""
        n = len(unit)
        key, far = np.full((n, 1), table + 1, np.int64), np.zeros((n, 1))
        for depth in range(len(AXES)):
            full = np.isin(key, crowded)
            if not full.any():
                break
            code, more = self.values(unit, table, depth, PLACES)
            finer = np.where(full[:, :, None], key[:, :, None] * self.radix + code[:, None, :], key[:, :, None])
            more = np.where(full[:, :, None], more[:, None, :], np.where(np.arange(code.shape[1]) == 0, 0.0, np.inf))
            cost = (far[:, :, None] + more).reshape(n, -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :PLACES]
            key, far = np.take_along_axis(finer.reshape(n, -1), best, 1), np.take_along_axis(cost, best, 1)
        rows, column = np.nonzero(np.isfinite(far))
        return rows, key[rows, column]


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps tiny numbers from vanishing when squared
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column, wide: int) -> Column:
    """Exactly ``wide`` finite numbers, not all zero."""
    low, high, endless = F.array_min(vector), F.array_max(vector), F.lit(float("inf"))  # not a number counts as the largest
    return F.coalesce((F.size(vector) == wide) & F.forall(vector, lambda x: x.isNotNull()) & (low > -endless) & (high < endless) & ((low != 0) | (high != 0)), F.lit(False))


def _counted(vectors: DataFrame, keys_of, over: int) -> dict[int, int]:
    """Exact numbers of rows per key, of those with more than ``over``; summed within each task first.

    There are as many keys as regions of the tree at most (see ``AXES``), whatever the number of vectors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                new, times = np.unique(keys_of(_unit(_vectors(batch))), return_counts=True)
                keys, at = np.unique(np.r_[keys, new], return_inverse=True)
                n = np.bincount(at, np.r_[n, times], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    counts = vectors.select("vec").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in counts.where(F.col("n") > over).collect()}


def _closest(asked: np.ndarray, names: np.ndarray, known: np.ndarray, others: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(cid, near, similarity): of each of ``asked`` the k most similar of ``known`` with another cid."""
    rough, wide = known.astype(np.float32), 32 if len(known) >= 64 * (k + 1) else 1
    groups = -(-len(known) // wide)
    for lo in range(0, len(asked), BLOCK):
        part, own = asked[lo : lo + BLOCK], names[lo : lo + BLOCK]
        similar = np.full((len(part), groups * wide), -2, np.float32)
        np.matmul(part.astype(np.float32), rough.T, out=similar[:, : len(known)])
        # The k + 1 largest of the groups' maxima are values of the row, so its k + 1 largest are not smaller.
        tops = similar.reshape(len(part), groups, wide).max(2)
        least = np.partition(tops, max(0, groups - k - 1), axis=1)[:, max(0, groups - k - 1)]
        x, y = np.nonzero(similar[:, : len(known)] >= least[:, None] - MARGIN)
        x, y = (z[own[x] != others[y]] for z in (x, y))
        value = np.round(np.einsum("ij,ij->i", part[x], known[y]), 9)
        q, near, value = _first(own[x], others[y], value, k)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(near), pa.array(value)], ["cid", "near", "similarity"])


def _first(q: np.ndarray, near: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest values of each q, of equals the smaller near; a pair counts once."""
    order = np.lexsort((near, -value, q))
    q, near, value = q[order], near[order], value[order]
    kept = np.r_[True, (q[1:] != q[:-1]) | (near[1:] != near[:-1])][: len(q)]  # equal pairs have equal values
    q, near, value = q[kept], near[kept], value[kept]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[rank < k], near[rank < k], value[rank < k]


def nearest(vectors: DataFrame, wide: int, k: int) -> DataFrame:
    """(cid, near, similarity): up to k candidates of each of the distinct ``vectors`` (cid, vec).

    Similarities are exact cosines rounded to 9 decimals; of equals the smaller cid comes first.
    """
    spark = vectors.sparkSession
    hasher = Hasher(wide)
    kind = np.float32 if vectors.schema["vec"].dataType.elementType.typeName() == "float" else np.float64
    full = _counted(vectors, lambda unit: np.concatenate([key for table in range(TABLES) for key in hasher.homes(unit, table)]), CROWDED)
    crowded = spark.sparkContext.broadcast(np.array(sorted(full), np.int64))
    large = _counted(vectors, lambda unit: np.concatenate([hasher.places(unit, table, crowded.value)[1] for table in range(TABLES)]), REGION)
    blocks = spark.sparkContext.broadcast((np.array(sorted(large), np.int64), np.array([-(-large[key] // REGION) for key in sorted(large)], np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ways = blocks.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, cid = _vectors(batch), batch.column("cid").to_numpy()
            unit = _unit(raw)
            plain = np.ascontiguousarray(raw.astype(kind))  # as delivered, so nothing is lost
            plain = pa.FixedSizeBinaryArray.from_buffers(pa.binary(plain.itemsize * wide), len(raw), [None, pa.py_buffer(plain.tobytes())]).cast(pa.binary())
            for table in range(TABLES):
                rows, key = hasher.places(unit, table, crowded.value)
                side = np.zeros(len(key), np.int8)
                if len(split):
                    at = np.minimum(np.searchsorted(split, key), len(split) - 1)
                    n = np.where(split[at] == key, ways[at], 1)
                    own = (cid[rows].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(20)).astype(np.int64) % n
                    again = np.repeat(np.arange(len(key)), n)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                    rows, own = rows[again], own[again]
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    side = np.where(low == high, 0, np.where(own == low, 1, 2)).astype(np.int8)
                    with np.errstate(over="ignore"):
                        key = key[again] ^ ((low << 20 | high) * np.int64(0x2545F4914F6CDD1D))
                for lo in range(0, len(key), 20_000):
                    part = pa.array(rows[lo : lo + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 20_000]), pa.array(side[lo : lo + 20_000]), pa.array(cid).take(part), plain.take(part)], ["key", "side", "cid", "vec"])

    regions = vectors.mapInArrow(place, "key long, side byte, cid long, vec binary").repartition("key").sortWithinPartitions("key", "side", "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, "key"):
            keys, side, cid = (table.column(c).to_numpy() for c in ("key", "side", "cid"))
            unit = _unit(np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).reshape(len(keys), wide).astype(float))
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
                if b - a < 2:
                    continue
                if not side[a]:
                    yield from _closest(unit[a:b], cid[a:b], unit[a:b], cid[a:b], k)
                elif (at := a + int(np.searchsorted(side[a:b], 2))) < b:
                    yield from _closest(unit[a:at], cid[a:at], unit[at:b], cid[at:b], k)
                    yield from _closest(unit[at:b], cid[at:b], unit[a:at], cid[a:at], k)

    pairs = regions.mapInArrow(compare, "cid long, near long, similarity double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, "cid"):
            best = _first(*(table.column(c).to_numpy() for c in ("cid", "near", "similarity")), k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["cid", "near", "similarity"])

    return pairs.repartition("cid").sortWithinPartitions("cid").mapInArrow(merge, "cid long, near long, similarity double")


def most_similar(points: DataFrame, wide: int = 64, k: int = 5) -> DataFrame:
    """(point_id, rank, neighbour_id, similarity): the k points most similar to each usable point.

    Usable are vectors of exactly ``wide`` finite numbers, not all zero, of points with an id; of
    several usable rows of one point the one embedded last counts (of equals the larger hash). Equal
    vectors are one class: it is hashed once, and its members get each other (the smallest ids) at
    similarity 1, so a group of copies of any size costs as much as its members. Ties go to the
    smaller id. Points without any candidate have no rows; candidates come from hashing, so recall
    is below 1. Vectors are shuffled once to find the distinct ones and then once per place.
    """
    fit = points.where("point_id is not null").where(usable(F.col("cfr_dense"), wide)).withColumns({"_h": F.xxhash64("cfr_dense"), "_g": F.hash("cfr_dense")})
    rows = fit.groupBy("point_id").agg(F.max(F.struct("embedded_at", "_h", "_g")).alias("_last")).select("point_id", "_last._h", "_last._g")
    rows = cut(rows, "points")
    rank = F.expr("row_number() over (partition by _h, _g order by point_id)")
    heads = rows.withColumn("_n", rank).where(F.col("_n") <= k + 1)
    classes = heads.groupBy("_h", "_g").agg(F.min("point_id").alias("point_id"), F.sort_array(F.collect_list("point_id")).alias("heads"))
    ordered = classes.repartitionByRange("point_id").sortWithinPartitions("point_id").withColumn("cid", F.monotonically_increasing_id()).drop("point_id")
    classes = cut(ordered, "classes")  # cid follows the smallest id
    distinct = fit.groupBy("_h", "_g").agg(F.first("cfr_dense").alias("vec"))  # equal within a class
    vectors = cut(distinct.join(classes.select("_h", "_g", "cid"), ["_h", "_g"]).select("cid", "vec"), "vectors")
    near = nearest(vectors, wide, k + 1)
    own = classes.where(F.size("heads") > 1).select("cid", F.col("cid").alias("near"), F.lit(1.0).alias("similarity"))
    named = near.unionByName(own).join(classes.select(F.col("cid").alias("near"), "heads"), "near")
    # At most k + 2 classes with k + 1 heads each.
    lists = named.groupBy("cid").agg(F.flatten(F.collect_list(F.transform("heads", lambda h: F.struct((-F.col("similarity")).alias("far"), h.alias("id"))))).alias("list"))
    lists = lists.select("cid", F.slice(F.sort_array("list"), 1, k + 1).alias("list"))
    listed = classes.select("cid", "_h", "_g", "heads").join(lists, "cid")
    few = listed.where(F.size("heads") <= k).select(F.explode("heads").alias("point_id"), "list")  # all their members are heads
    ways = F.explode(F.array(*[F.lit(i) for i in range(WAYS)]))
    many = listed.where(F.size("heads") > k).select("_h", "_g", "list", ways.alias("_way"))
    members = few.unionByName(rows.select("point_id", "_h", "_g", salt("point_id", WAYS).alias("_way")).join(many, ["_h", "_g", "_way"]).select("point_id", "list"))
    others = members.select("point_id", F.slice(F.filter("list", lambda x: x["id"] != F.col("point_id")), 1, k).alias("list"))
    return others.select("point_id", F.posexplode("list").alias("_at", "_x")).select("point_id", (F.col("_at") + 1).alias("rank"), F.col("_x.id").alias("neighbour_id"), (-F.col("_x.far")).alias("similarity"))


def similar_pairs(neighbours: DataFrame, least: float = 0.85) -> DataFrame:
    """Distinct (point_id_a, point_id_b), a < b, of neighbours at least that similar."""
    kept = neighbours.where(F.col("similarity") >= least)
    return kept.select(F.least("point_id", "neighbour_id").alias("point_id_a"), F.greatest("point_id", "neighbour_id").alias("point_id_b")).distinct()
