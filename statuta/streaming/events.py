"""Windows and last states over event streams; the same functions work on batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per window; rows later than ``late`` behind the watermark are dropped in streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): bursts of a user's events that are less than ``gap`` apart; events without user have none."""
    rows = events.where("user_id is not null")
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_states(events: DataFrame, key: str = "user_id", state: str = "event_type") -> DataFrame:
    """(key, last_state, last_ts): the latest state per key, of equal times that of the larger event_id."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("ts", "event_id", state)).alias("_m")).select(key, F.col(f"_m.{state}").alias("last_state"), F.col("_m.ts").alias("last_ts"))


def transitions(events: DataFrame, key: str = "user_id", state: str = "event_type") -> DataFrame:
    """(from_state, to_state, n) between neighbouring events of a key, in batches."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.select(F.lag(state).over(order).alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def state_changes(events: DataFrame, allowed: dict[str, tuple[str, ...]], start: tuple[str, ...], key: str = "user_id", state: str = "event_type") -> DataFrame:
    """(key, state, n_applied, n_refused) of a stream: each key's state, kept between batches, when it has events.

    An event moves its key only where ``allowed`` has its state after the present one (``start`` for
    a new key); others are refused and counted. Within a batch events are taken by (ts, event_id).
    The state of a key is three numbers, whatever its number of events.
    """
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), "ts", "event_id", F.col(state).alias("state"))

    def step(key_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, applied, refused = held.get if held.exists else (None, 0, 0)
        batch = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for after in batch["state"]:
            if after in (start if now is None else allowed.get(now, ())):
                now, applied = after, applied + 1
            else:
                refused += 1
        held.update((now, applied, refused))
        yield pd.DataFrame({"key": [key_[0]], "state": [now], "n_applied": [applied], "n_refused": [refused]})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, state string, n_applied long, n_refused long", "state string, n_applied long, n_refused long", "update", GroupStateTimeout.NoTimeout)
