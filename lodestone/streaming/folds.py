"""Streaming forms of the state operators: windowed counts, a map with time to live, an append-only log for latest_per_key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str, value: str | None = None) -> DataFrame:
    """(start, end, keys, n[, total]) of tumbling windows; rows later than the watermark are dropped, in a stream only."""
    sums = [F.sum(value).alias("total")] if value else []
    found = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def ttl_map(events: DataFrame, key: str, seq: str, value: str, at: str, ttl: int, late: str) -> DataFrame:
    """(key, seq, value, valid): updates of a map whose entries end ttl seconds after their time, told by the watermark.

    A key's state is its entry with the largest seq, never its log; entries come once when put and once more, not valid,
    when they end. seq is a whole number, values are sent as strings. A null key is a key like any other.
    """
    schema = f"{key} string, {seq} bigint, {value} string, valid boolean"
    sent = events.withWatermark(at, late).select(F.col(key).cast("string").alias(key), F.col(seq).cast("bigint").alias(seq), F.col(value).cast("string").alias(value), at)

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held, last, _ = state.get
            state.remove()
            yield pd.DataFrame([(name[0], held, last, False)], columns=[key, seq, value, "valid"])
            return
        best = state.get if state.exists else None
        before = best
        for batch in batches:
            row = batch.loc[batch[seq].idxmax()]
            if best is None or row[seq] > best[0]:
                best = (int(row[seq]), row[value], int(row[at].timestamp() * 1000))
        state.update(best)
        state.setTimeoutTimestamp(max(best[2] + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        if best != before:
            yield pd.DataFrame([(name[0], best[0], best[1], True)], columns=[key, seq, value, "valid"])

    return sent.groupBy(key).applyInPandasWithState(fold, schema, f"{seq} bigint, {value} string, at bigint", "update", GroupStateTimeout.EventTimeTimeout)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Start writing stream to the Parquet log at path, each row once; operators.state.latest_per_key reads the map from it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
