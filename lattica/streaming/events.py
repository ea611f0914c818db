"""Event streams. Each function takes a streaming or a batch DataFrame and gives back one of the same kind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattica.tables import ready, shared_folder


def read_events(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """start, keys, n, total per window; rows later than the watermark don't count in a stream."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, value: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width, step)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """keys, start, end, n: runs of events with less than `gap` between them; end is the last event's time plus the gap."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Rows without those that repeat keys within the watermark (all repeats in a batch)."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def running_ema(events: DataFrame, key: str, at: str, value: str, keep: float = 0.95, late: str = "10 minutes", forget_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """key, n, ema after each micro-batch: rows of a batch are folded in order of time, state goes on between batches.

    A key whose last row is forget_ms behind the watermark is forgotten, so that state doesn't grow for ever; it starts anew
    when it comes again.
    """
    ready(events.sparkSession)
    kind = dict(events.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, ema = state.get if state.exists else (0, 0.0)
        own = pd.concat([part[[at, value]] for part in parts]).sort_values(at, kind="stable")
        for x in own[value]:
            n, ema = n + 1, ema * keep + float(x) * (1 - keep)
        state.update((n, ema))
        state.setTimeoutTimestamp(max(int(own[at].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [ema]})

    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now through a stream, into a table in memory; for checks and small results."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/lattica/stream-{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
