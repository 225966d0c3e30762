"""Filling fixed-capacity containers with items (problem 7).

Bulk-synchronous best fit: documents and gaps are sorted, each round matches one size class of
documents with the smallest gaps that hold it, rank decides within a class, gaps are updated, and
the next class follows. Sizes are whole numbers of at most the capacity, so documents and gaps
stand for each other by class and rank: the sweeps run over classes and intervals of ranks, whose
number is bounded by the capacity, not by the documents, and the documents find their container by
their rank alone.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.runtime import cut, spread

CAPACITY = 2048
#: A public byte-level BPE vocabulary as ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are cut before merging (fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document with an id; null and empty texts have 0 tokens."""
    with open(vocabulary, "rb") as lines:  # its size is fixed by the vocabulary
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(text)) if isinstance(text, str) else 0 for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": sizes})

    return spread(documents.where("doc_id is not null").select("doc_id", "text"), "doc_id").mapInPandas(count, "doc_id long, n_tokens long")


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """Where items go, sizes descending: [(first item, its container)] by intervals, and containers used.

    An interval lasts until the next one's first item, and its items go to consecutive containers.
    Each step takes the smallest gap class that holds the size, and in it the containers opened first.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    placed, item, opened = [], 0, 0

    def leave(gap: int, start: int, end: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((start, end))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(order, size)
            if at == len(order):
                count = math.ceil(left / (capacity // size))
                leave(capacity, opened, opened + count)
                opened += count
                continue
            gap = order[at]
            start, end = gaps[gap].pop(0)
            take = min(left, end - start)
            if start + take < end:
                gaps[gap].insert(0, (start + take, end))
            elif not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            placed.append((item, start))
            leave(gap - size, start, start + take)
            item, left = item + take, left - take
    return placed, opened


def pack_items(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, position, doc_id, piece_no, token_from, n_tokens) of items (doc_id, n_tokens).

    An item longer than a container is divided into full containers and a rest that is packed like
    any other; nothing else is split. Items without tokens take no room: they come out with null
    container_id and position. Within a container positions follow falling size, then doc_id.
    Repeated rows are items of their own. Equal sizes may be a third of all rows: ranks come from a
    range sort over size and id, so no task holds a whole class.
    """
    spark = sizes.sparkSession
    known = sizes.select("doc_id", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("all"))
    pieces = known.where("all > 0").select("doc_id", "all", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / capacity).cast("int"))).alias("no"))
    pieces = pieces.select("doc_id", (F.col("no") + 1).alias("piece_no"), (F.col("no").cast("long") * capacity).alias("token_from"), F.least(F.lit(capacity), F.col("all") - F.col("no").cast("long") * capacity).cast("int").alias("n_tokens"))
    ranged = pieces.repartitionByRange(F.desc("n_tokens"), "doc_id", "piece_no").sortWithinPartitions(F.desc("n_tokens"), "doc_id", "piece_no")
    ranked = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.expr("_at & 8589934591"))
    histogram = {r[0]: r[1] for r in ranked.groupBy("n_tokens").count().collect()}  # at most capacity rows
    offsets, start = {}, 0
    for part, rows in sorted(map(tuple, ranked.groupBy("_part").count().collect())):  # one row per partition
        offsets[part], start = start, start + rows
    placed, _ = best_fit(histogram, capacity)
    shared = spark.sparkContext.broadcast((np.array([p[0] for p in placed] or [0]), np.array([p[1] for p in placed] or [0]), offsets))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, containers, offset = shared.value
        for batch in batches:
            rank = batch["_row"].to_numpy() + batch["_part"].map(offset).to_numpy(np.int64)
            at = np.searchsorted(firsts, rank, "right") - 1
            yield batch[["doc_id", "piece_no", "token_from", "n_tokens"]].assign(container_id=containers[at] + rank - firsts[at], _rank=rank)

    filled = ranked.mapInPandas(assign, "doc_id long, piece_no int, token_from long, n_tokens int, container_id long, _rank long")
    # A container holds at most `capacity` items, so its window is bounded.
    position = F.expr("row_number() over (partition by container_id order by _rank)").cast("int")
    columns = ["container_id", "position", "doc_id", "piece_no", "token_from", "n_tokens"]
    empty = known.where("all <= 0").select(F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("position"), "doc_id", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("token_from"), F.lit(0).alias("n_tokens"))
    return filled.withColumn("position", position).select(columns).unionByName(empty)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens and the share of room that is filled."""
    totals = packed.where("container_id is not null").agg(F.coalesce(F.max("container_id") + 1, F.lit(0)).alias("n_containers"), F.count("*").alias("n_items"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return totals.withColumn("fill_share", F.when(F.col("n_containers") > 0, F.col("n_tokens") / (F.col("n_containers") * capacity)))


def read_counts(spark: SparkSession, documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts, written once: the texts are tokenised a single time however often sizes are used."""
    return cut(token_counts(documents, vocabulary), "sizes")
