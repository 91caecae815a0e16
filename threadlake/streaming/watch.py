"""Indexing as a stream: new or changed files are found by a file source and their sessions replaced as a whole.

Late lines need no watermark, since a session is always read again from all its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlake.plans.ingest import IndexConfig, index
from threadlake.sources.store import Store


def watch(spark: SparkSession, store: Store, config: IndexConfig, folder: str, checkpoint: str, once: bool = True):
    """A query that indexes whenever files appear below folder; with once it ends when all there is was read."""
    files = spark.readStream.format("text").option("recursiveFileLookup", True).option("wholetext", True).load(folder)

    def run(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            index(batch.sparkSession, store, config)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="4 hours")).start()
