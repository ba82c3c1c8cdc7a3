"""Recent symbols per session as streaming state."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeweft.operators.sessions import MAX_RECENT

FIELDS = "ts_micros array<bigint>, event_id array<bigint>, symbol array<string>"


def recent_state(events: DataFrame, bound: int = MAX_RECENT) -> DataFrame:
    """Stream of (session_id, ts, event_id, symbol) to the current newest ``bound`` symbols of every updated session.

    Each task first trims its Arrow batches to the bound, so one busy session does not send all its events to one task.
    Arrival order does not matter: state is ordered by (ts, event_id).
    """
    session_type = dict(events.dtypes)["session_id"]
    rows = events.select("session_id", F.unix_micros("ts").alias("ts_micros"), "event_id", "symbol")

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(["ts_micros", "event_id"]).groupby("session_id", sort=False).tail(bound)

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            incoming = zip(batch["ts_micros"].tolist(), batch["event_id"].tolist(), batch["symbol"].tolist())
            newest = heapq.nlargest(bound, [*newest, *incoming])
        columns = tuple(list(column) for column in zip(*newest))
        state.update(columns)
        yield pd.DataFrame({"session_id": [key[0]], "ts_micros": [columns[0]], "event_id": [columns[1]], "symbol": [columns[2]]})

    trimmed = rows.mapInPandas(trim, rows.schema)
    return trimmed.groupBy("session_id").applyInPandasWithState(
        update, f"session_id {session_type}, {FIELDS}", FIELDS, "update", GroupStateTimeout.NoTimeout
    )


def run_recent_state(events: DataFrame, folder: str, bound: int = MAX_RECENT) -> DataFrame:
    """Process everything available and return the final state as (session_id, event_id, symbol, age)."""
    spark = events.sparkSession

    def commit(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a replayed batch harmless.
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch_id}")

    query = (
        recent_state(events, bound)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(commit)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    updates = spark.read.parquet(f"{folder}/updates")
    last = updates.groupBy("session_id").agg(F.max_by(F.arrays_zip("event_id", "symbol"), "batch").alias("recent"))
    entries = last.select("session_id", F.posexplode("recent").alias("at", "r"))
    return entries.select("session_id", "r.event_id", "r.symbol", (F.col("at") + 1).alias("age"))
