"""Near-duplicate records (problem 4): an exact Jaccard join of word sets.

Regions are words, not documents: with documents as pivots the triangle-inequality windows of
unrelated texts cover every region (see README), so each set goes to the regions of its rarest
words. For sets x and y of similarity t or more the words before their first common one are in one
of the two only, so positions i and j of that word satisfy i + j <= h(x, y) = (1 - t) / (1 + t) *
(|x| + |y|), the largest possible symmetric difference. In a region the positions and sizes give
windows, parities of the hashed words from there on bound the rest of the symmetric difference from
below, and what is left is verified on the words themselves. No pair is lost, and a region too large for one task is split
into blocks that meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import words
from statuta.llm.runs import sorted_runs
from statuta.runtime import cut

#: At most so many words have a rank of their own (the bound of what is broadcast); others count as
#: rarest, in the order of their hashes. Any order of words gives the right result.
RANKED = 400_000
#: Rows of a region beyond which it is split into blocks.
REGION = 20_000
LANES = ("p0", "p1", "p2")


def _suffix_parities(flat: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each word of each set the parity, in 64 cells a lane, of the set's words from there on."""
    cell = (flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    bits = np.zeros((len(flat) + 1, len(LANES)), np.uint64)
    bits[np.arange(len(flat)), ((cell >> np.uint64(6)) % np.uint64(len(LANES))).astype(np.int64)] = np.uint64(1) << (cell & np.uint64(63))
    before = np.bitwise_xor.accumulate(np.roll(bits, 1, axis=0), axis=0)  # of all words before, in any set
    return np.repeat(before[starts + size], size, axis=0) ^ before[:-1]


def _regions(sets: DataFrame, threshold: float) -> DataFrame:
    """(region, side, slack, size, cid, parities): a row for every word that may be the first common one.

    slack is the set's share of the largest symmetric difference less the words before this one.
    """
    spark = sets.sparkSession
    counts = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = cut(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranked = counts.where(F.col("n") >= max(2, total / RANKED)).toPandas()  # at most RANKED rows
    ranked = ranked.sort_values(["n", "word"], ignore_index=True)
    hashes, n = ranked["word"].to_numpy(np.int64), ranked["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast((hashes[order], order.astype(np.int64) + 1, n[order]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank_of, rows_of = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column, cid = batch.column("words"), batch.column("cid").to_numpy()
            flat = column.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(column.offsets.to_numpy())
            starts = np.r_[0, np.cumsum(size)[:-1]]
            owner = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            hit = (known[at] == flat) if len(known) else np.zeros(len(flat), bool)
            rank = np.where(hit, rank_of[at] if len(known) else 0, 0)
            rows = np.where(hit, rows_of[at] if len(known) else 0, 0)
            sort = np.lexsort((flat, rank, owner))
            flat, rows = flat[sort], rows[sort]
            lanes = _suffix_parities(flat, starts, size).view(np.int64)
            place = np.arange(len(flat)) - np.repeat(starts, size)
            kept = place <= np.floor((1 - threshold) * size + 1e-9)[owner]
            slack = ((1 - threshold) / (1 + threshold) * size[owner] - place).astype(np.float32)
            flat, rows, slack, owner, lanes = flat[kept], rows[kept], slack[kept], owner[kept], lanes[kept]
            blocks = np.maximum(1, -(-rows // REGION))
            own = (cid[owner].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(20)).astype(np.int64) % blocks
            again = np.repeat(np.arange(len(flat)), blocks)
            other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            flat, slack, owner, own, lanes = flat[again], slack[again], owner[again], own[again], lanes[again]
            low, high = np.minimum(own, other), np.maximum(own, other)
            with np.errstate(over="ignore"):
                region = flat ^ ((low << 20 | high) * np.int64(0x2545F4914F6CDD1D))
            side = np.where(low == high, 0, np.where(own == low, 1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(region), pa.array(side, pa.int8()), pa.array(slack), pa.array(size[owner], pa.int32()), pa.array(cid[owner]), *(pa.array(lanes[:, k]) for k in range(len(LANES)))],
                ["region", "side", "slack", "size", "cid", *LANES],
            )

    return sets.select("cid", "words").mapInArrow(spread, "region long, side byte, slack float, size int, cid long, " + ", ".join(f"{lane} long" for lane in LANES))


def _candidates(slack: np.ndarray, size: np.ndarray, side: np.ndarray, cid: np.ndarray, lanes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a region, sorted by falling slack, that pass the windows and the parities."""
    n, rows, wide = len(slack), 128, 4096
    for a in range(0, n, rows):
        b = min(a + rows, n)
        end = n - int(np.searchsorted(slack[::-1], -slack[a] - 1e-3, "left"))
        for c in range(a, end, wide):
            d = min(c + wide, end)
            most = int(slack[a] + slack[c] + 1e-3)  # the loosest of the block
            if most < 0:
                break
            apart = np.bitwise_count(lanes[0][a:b, None] ^ lanes[0][None, c:d])
            x, y = np.divmod(np.flatnonzero(apart.ravel() <= most), d - c)
            x, y = x + a, y + c
            limit = slack[x] + slack[y] + 1e-3
            ok = (y > x) & (apart.ravel()[(x - a) * (d - c) + y - c] <= limit)
            x, y, limit = x[ok], y[ok], limit[ok]
            ok = sum(np.bitwise_count(lane[x] ^ lane[y]).astype(np.int16) for lane in lanes) <= limit
            x, y = x[ok], y[ok]
            ok = (np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9) & (cid[x] != cid[y]) & ((side[x] != side[y]) | (side[x] == 0))
            if ok.any():
                yield x[ok], y[ok]


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(cid_a, cid_b, n_common, n_union), cid_a < cid_b, of all pairs of sets with that Jaccard similarity.

    ``sets`` has cid, distinct, and words, an array of distinct 64-bit hashes. Empty sets have no
    pairs. Every pair comes out once.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, "region"):
            region = table.column("region").to_numpy()
            slack, size, side, cid = (table.column(c).to_numpy() for c in ("slack", "size", "side", "cid"))
            lanes = [table.column(c).to_numpy().view(np.uint64) for c in LANES]
            starts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
            found = []
            for a, b in zip(starts, np.r_[starts[1:], len(region)]):
                if b - a > 1:
                    for x, y in _candidates(slack[a:b], size[a:b], side[a:b], cid[a:b], [lane[a:b] for lane in lanes], threshold):
                        p, q = cid[a:b][x], cid[a:b][y]
                        found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["cid_a", "cid_b"])

    filled = sets.where(F.size("words") > 0)
    near = _regions(filled, threshold).repartition("region").sortWithinPartitions("region", F.desc("slack")).mapInArrow(compare, "cid_a long, cid_b long").distinct()
    a, b = (filled.select(F.col("cid").alias(f"cid_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
    checked = near.join(a, "cid_a").join(b, "cid_b").withColumn("n_common", F.size(F.array_intersect("words_a", "words_b")))
    checked = checked.withColumn("n_union", F.size("words_a") + F.size("words_b") - F.col("n_common"))
    return checked.where(F.col("n_common") >= threshold * F.col("n_union") - 1e-9).select("cid_a", "cid_b", "n_common", "n_union")


def term(defines: Column) -> Column:
    """A defined term without case, blanks and hyphens; null if nothing is left."""
    plain = F.regexp_replace(F.lower(defines), r"(?U)[\s\-‐‑]+", "")
    return F.when(plain != "", plain)


def word_sets(chunks: DataFrame, least_words: int = 12) -> tuple[DataFrame, DataFrame]:
    """Members (chunk_id, term, cid) and sets (cid, words) of chunks with texts of enough words.

    Chunks with the same set of words are one class, so copies are joined once. Of several rows of
    a chunk the one with the largest text counts. Null, empty and short texts have no class.
    """
    one = chunks.where("chunk_id is not null and text is not null").groupBy("chunk_id").agg(F.max(F.struct("text", "defines")).alias("_x"))
    split = one.select("chunk_id", term(F.col("_x.defines")).alias("term"), words(F.col("_x.text")).alias("_w")).where(F.size("_w") >= least_words)
    hashed = split.select("chunk_id", "term", F.array_sort(F.transform(F.array_distinct("_w"), lambda w: F.xxhash64(w))).alias("words"))
    hashed = cut(hashed.select("*", F.xxhash64("words").alias("_h"), F.hash("words").alias("_g")), "sets")
    sets = hashed.groupBy("_h", "_g").agg(F.first("words").alias("words"))  # equal within a class
    sets = cut(sets.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = hashed.select("chunk_id", "term", "_h", "_g").join(sets.select("cid", "_h", "_g"), ["_h", "_g"]).select("chunk_id", "term", "cid")
    return members, sets.select("cid", "words")


def near_duplicates(chunks: DataFrame, threshold: float = 0.7, least_words: int = 12) -> tuple[DataFrame, DataFrame]:
    """Members (chunk_id, term, cid) and class pairs (cid_a, cid_b, n_common, n_union)."""
    members, sets = word_sets(chunks, least_words)
    members = cut(members, "members")
    return members, similar_sets(sets, threshold)


def chunk_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b, of the members of similar classes and of one class.

    Pairs whose members define different terms are left out; a member that defines none goes with all.
    """
    copies = members.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b"))
    a, b = (members.select(F.col("chunk_id").alias(f"_{x}"), F.col("term").alias(f"_term_{x}"), F.col("cid").alias(f"cid_{x}")) for x in "ab")
    both = pairs.select("cid_a", "cid_b").unionByName(copies).join(a, "cid_a").join(b, "cid_b")
    both = both.where((F.col("cid_a") != F.col("cid_b")) | (F.col("_a") < F.col("_b"))).where(F.coalesce(F.col("_term_a") == F.col("_term_b"), F.lit(True)))
    return both.select(F.least("_a", "_b").alias("chunk_id_a"), F.greatest("_a", "_b").alias("chunk_id_b"))


def linked_members(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chunk_id, class_id, n_copies, n_links): every chunk with its class and the number of chunks it goes with.

    A link is a pair of ``chunk_pairs``: chunks of similar classes and of one class whose terms do not
    differ. Links are summed from the counts of terms per class, so no pair of chunks is made.
    """
    terms = cut(members.groupBy("cid", "term").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first")), "terms")
    sizes = terms.groupBy("cid").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_copies"), F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col("n"))), F.lit(0)).alias("free"))
    near = pairs.select("cid_a", "cid_b").unionByName(pairs.select(F.col("cid_b").alias("cid_a"), F.col("cid_a").alias("cid_b"))).unionByName(sizes.select(F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b")))
    near = cut(near, "links")
    around = near.join(sizes.select(F.col("cid").alias("cid_b"), "n_copies", "free"), "cid_b").groupBy(F.col("cid_a").alias("cid")).agg(F.sum("n_copies").alias("every"), F.sum("free").alias("any_term"))
    same = near.join(terms.where("term is not null").select(F.col("cid").alias("cid_b"), "term", "n"), "cid_b").groupBy(F.col("cid_a").alias("cid"), "term").agg(F.sum("n").alias("same_term"))
    counted = terms.select("cid", "term").join(sizes.select("cid", "class_id", "n_copies"), "cid").join(around, "cid").join(same, ["cid", "term"], "left")
    links = F.when(F.col("term").isNull(), F.col("every")).otherwise(F.col("any_term") + F.coalesce("same_term", F.lit(0))) - 1
    counted = counted.select("cid", F.coalesce("term", F.lit("")).alias("term"), "class_id", "n_copies", links.alias("n_links"))
    return members.select("chunk_id", "cid", F.coalesce("term", F.lit("")).alias("term")).join(counted, ["cid", "term"]).select("chunk_id", "class_id", "n_copies", "n_links")
