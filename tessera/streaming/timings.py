"""Streams of query timings: windows with late data, the newest few per key, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file, which streams accept as a pattern only."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """With a watermark, which needs a time with a zone: times without one are taken in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts, sums and extremes per window and key; events later than `late` are left out in a stream."""
    w = F.window(ts, width)
    marked = _marked(events, ts, late) if events.isStreaming else events
    return marked.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n", "total", "least", "most")


def distinct_events(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return _marked(events, ts, late).dropDuplicatesWithinWatermark(keys)


def newest_per_key(events: DataFrame, n: int = 1000, key: str = "user_id", ts: str = "ts", value: str = "value", ttl_ms: int | None = None) -> DataFrame:
    """A stream of (key, n, mean) over the newest n values of each key.

    With ttl_ms, a key unseen for so long is dropped; such a query looks for expired keys for ever, and so
    must not be run with an availableNow trigger."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept: list[tuple[int, float]] = [*zip(*state.get, strict=True)] if state.exists else []
        for f in frames:
            kept += zip(f[ts].astype("int64").tolist(), f[value].tolist(), strict=True)
        kept = sorted(kept)[-n:]
        state.update(([a for a, _ in kept], [b for _, b in kept]))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [k[0]], "n": [len(kept)], "mean": [sum(b for _, b in kept) / len(kept)]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, mean double", "at array<long>, v array<double>", "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Write what is there to a Parquet folder and read it."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """As run_once, for aggregates: the last batch's whole result, by overwriting."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
