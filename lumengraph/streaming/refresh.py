"""Structured Streaming: windowed event counts, the last rows of each key, and tables and indexes kept current by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumengraph.sources.index import VaultIndex
from lumengraph.sources.store import VersionedTable


def _timed(events: DataFrame, late: str) -> DataFrame:
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    return at.withWatermark("at", late) if events.isStreaming else at


def _counted(events: DataFrame, window: Column, *keys: str) -> DataFrame:
    g = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events", "total")


def event_windows(events: DataFrame, size: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, events, total) of tumbling windows, or, with ``slide``, of windows that overlap; on a stream, late
    rows are dropped after ``late``."""
    return _counted(_timed(events, late), F.window("at", size, slide) if slide else F.window("at", size), "event_type")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, end, user_id, events, total) of each user's runs of events without a longer gap."""
    return _counted(_timed(events, late), F.session_window("at", gap), "user_id")


def last_rows_stream(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """(key, order, seen) after each micro-batch: the last ``n`` values of each key that it touched, held in state of that size."""
    kinds = dict(events.dtypes)
    schema = f"`{key}` {kinds[key]}, `{order}` array<{kinds[order]}>, seen long"

    def run(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = state.get if state.exists else ([], 0)
        for p in parts:
            held = sorted([*held, *p[order].tolist()])[-n:]
            seen += len(p)
        state.update((held, seen))
        yield pd.DataFrame({key: [own[0]], order: [held[::-1]], "seen": [seen]})

    return events.groupBy(key).applyInPandasWithState(run, schema, f"held array<{kinds[order]}>, seen long", "update", GroupStateTimeout.NoTimeout)


def rows_of(spark: SparkSession, path: str, schema: str, most_files: int | None = None) -> DataFrame:
    """A stream of the Parquet files that come to a folder; ``most_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).parquet(path)


def keep_current(stream: DataFrame, table: VersionedTable, checkpoint: str, order: str, keep: int = 5) -> StreamingQuery:
    """Upsert each micro-batch: of all rows of a key the one of greatest ``order`` stays, whichever batch it came in; every batch is one
    new version of the buckets that it touches, so a batch that runs again gives the same table, and readers of the last ``keep``
    versions aren't disturbed."""

    def apply(batch: DataFrame, _: int) -> None:
        table.upsert(batch, order)
        table.vacuum(keep)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(index: VaultIndex, checkpoint: str, seconds: float = 2) -> StreamingQuery:
    """Look for notes that came, changed or went every so many seconds, and apply the differences: file streams only tell of new
    paths, so each micro-batch compares whole snapshots."""
    ticks = index.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def apply(_: DataFrame, __: int) -> None:
        index.incremental()

    return ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def fan_out(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to several sinks, with its number; a sink that has had a batch must take it again without harm, as a batch
    whose sinks didn't all end is run again."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
