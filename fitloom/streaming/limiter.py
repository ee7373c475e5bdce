"""A fixed-window limiter anchored at each key's first request, view counts and upserts; batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fitloom.operators import upsert


def _fold(times: np.ndarray, start, count: int, window_us: int, limit: int):
    """Verdicts on requests in order of time, and the state after them; a step a window, not a request."""
    allowed = np.zeros(len(times), bool)
    i = 0
    while i < len(times):
        if start is None or times[i] - start >= window_us:
            start, count = int(times[i]), 0
        end = int(np.searchsorted(times, start + window_us, "left"))
        good = max(0, min(limit - count, end - i))
        allowed[i : i + good] = True
        count, i = count + good, max(end, i + 1)
    return allowed, start, count


def limit_requests(requests: DataFrame, window_us: int, limit: int) -> DataFrame:
    """(key, id, us, allowed) of requests (key, id, us): `limit` in a window that opens with a key's first request.

    Rows of a key are read in order as a stream of batches with a state of two numbers,
    so a key of any size needs no more memory.  A refused request does not count;
    equal times go by id; rows of a null key form one key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, count = object(), None, 0
        for rows in batches:
            keys, times = rows["key"], rows["us"].to_numpy()
            same = (keys == keys.shift()) | (keys.isna() & keys.shift().isna())
            cut = sorted({0, *np.flatnonzero(~same).tolist()}) if len(rows) else []
            verdicts = np.zeros(len(rows), bool)
            for a, b in zip(cut, [*cut[1:], len(rows)], strict=True):
                k = None if pd.isna(keys.iloc[a]) else keys.iloc[a]
                if k != key:
                    key, start, count = k, None, 0
                verdicts[a:b], start, count = _fold(times[a:b], start, count, window_us, limit)
            yield rows.assign(allowed=verdicts)

    ordered = requests.select("key", "id", "us").repartition("key").sortWithinPartitions("key", "us", "id")
    return ordered.mapInPandas(run, "key long, id long, us long, allowed boolean")


def limit_stream(requests: DataFrame, window_us: int, limit: int, late: str = "1 hour") -> DataFrame:
    """As limit_requests, over a stream: the state of a key is its window's start and count.

    Once the watermark (`late` behind the latest request) has passed the end of a key's window its state
    goes, as its next request opens a window anyway; requests older than the watermark are left out.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(frames).sort_values(["us", "id"])
        verdicts, start, count = _fold(rows["us"].to_numpy(), start, count, window_us, limit)
        state.update((int(start), int(count)))
        state.setTimeoutTimestamp(max((start + window_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "us": rows["us"], "allowed": verdicts})

    # A millisecond on, so that a request at the epoch itself is not behind the first watermark.
    marked = requests.withColumn("at", F.timestamp_micros(F.col("us") + 1000)).withWatermark("at", late)
    return marked.groupBy("key").applyInPandasWithState(run, "key long, id long, us long, allowed boolean", "start long, count int", "append", GroupStateTimeout.EventTimeTimeout)


def view_counts(events: DataFrame) -> DataFrame:
    """(user_id, views); the same plan serves a stream in complete or update mode."""
    return events.groupBy("user_id").agg(F.count("*").alias("views"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by epoch-aligned window and type, with a watermark; an extension beside the anchored limiter."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def upsert_stream(changes: DataFrame, path: str, keys: list[str], order: list[str], update: list[str], checkpoint: str):
    """A stream writer that applies each micro-batch of changes to the table at path; a batch that runs again changes nothing.

    The table must exist.  Returns the writer, to which the caller adds a trigger before start().
    """

    def apply(batch: DataFrame, _: int) -> None:
        table = batch.sparkSession.read.parquet(path)
        upsert.replace_table(upsert.upsert(table, batch.select(table.columns), keys, order, update), path)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
