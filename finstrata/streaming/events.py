"""Streams: events without repetitions, running state, windowed counts. An extension; the batch operators need none of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from finstrata.operators.store import upsert_last, write_swapped


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files landing under `path`, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def without_repeats(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; events that come later than `late` are dropped with their state."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, at: str, by: Sequence[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and group, emitted when the watermark has passed the window."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))


def keep_state(events: DataFrame, state_path: str, keys: Sequence[str], sequence: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Keep the last event per key in a parquet folder: each batch is merged with what is there and swapped in.

    A batch that runs again gives the same state, as the merge only depends on the sequence columns.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.schema(batch.schema).parquet(state_path)
        except Exception:  # noqa: BLE001 - no state yet
            old = batch.limit(0)
        write_swapped(upsert_last(old, batch, keys, sequence), state_path)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
