"""Streams over the library: idempotent upserts, the activity ring, progress and windowed counts.

Each is a plain function from a streaming DataFrame to one, or a foreachBatch function; state is bounded by a
watermark or by the ring's length.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioplan.sources.sinks import VersionedTable

RING = 120


def upserts(table: VersionedTable, key: str = "id", order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of each key the latest row of the batch goes into the table; a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if order:
            row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
            batch = batch.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, order).alias("_r")).select("_r.*")
        table.upsert(batch, key)

    return write


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total: tumbling windows; rows later than the watermark are dropped by it alone."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def progress(results: DataFrame) -> DataFrame:
    """Running totals by provider and status, for update or complete mode."""
    return results.groupBy("provider", "status").agg(F.count("*").alias("n"), F.sum("n_results").alias("results"))


def latest_by_token(states: DataFrame) -> DataFrame:
    """key, token, state: what the newest request of each key said; answers to older ones are stale."""
    return states.groupBy("key").agg(F.max("token").alias("token"), F.max_by("state", "token").alias("state"))


def distinct_within(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def activity_ring(events: DataFrame, size: int = RING) -> DataFrame:
    """Per user the latest ``size`` events, a repeated error counted once, as of the last batch.

    events: user_id, ts, event_type, value.  State holds at most ``size`` rows a user.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = json.loads(state.get[0]) if state.exists else []
        for b in batches:
            ring += [[int(t.value // 1000), e, v] for t, e, v in zip(b["ts"], b["event_type"], b["value"])]
        ring.sort(key=lambda r: (r[0], r[1], r[2]))
        kept = [r for k, r in enumerate(ring) if not (r[1] == "error" and k and ring[k - 1][1:] == r[1:])][-size:]
        state.update((json.dumps(kept),))
        yield pd.DataFrame({"user_id": [key[0]], "n_kept": [len(kept)], "oldest": [kept[0][0] if kept else None], "newest": [kept[-1][0] if kept else None]})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, n_kept bigint, oldest bigint, newest bigint", "ring string", "update", GroupStateTimeout.NoTimeout)
