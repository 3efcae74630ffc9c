"""Importing chunk files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codestrata.operators.importing import Options, Store, import_incremental
from codestrata.schema import CHUNK


def stream_chunks(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Chunks of JSON-line files as they appear in a folder."""
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_batch).json(folder)


def import_stream(chunks: DataFrame, load: Callable[[], Store], save: Callable[[Store, int], None], checkpoint: str, options: Options = Options(), last_saved: Callable[[], int] = lambda: -1) -> StreamingQuery:
    """Imports every batch incrementally into the store that `load` gives and hands the new one to `save`.

    `save` must write to a fresh place and switch over, since the new store still reads the old one, and keep the
    batch's number with it: a batch that comes again after a failure is left out if `last_saved` tells that number.
    """
    def run(batch: DataFrame, number: int) -> None:
        if number > last_saved() and batch.take(1):
            save(import_incremental(load(), batch, options), number)

    return chunks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
