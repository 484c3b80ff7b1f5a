"""Counts of taxa by cell over a stream of occurrences (beyond the batch run)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terramosaic.operators.occurrences import in_cells
from terramosaic.types import Bbox


def stream_counts(occurrences: DataFrame, cell_table: DataFrame, res: int, box: Bbox, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Add up each micro-batch by (cell, name, key) and append it under its batch id.

    A batch that runs again overwrites its own folder, so counts are exact;
    totals() adds the batches up.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        seen = in_cells(batch, box, res).join(cell_table.select("geocode"), "geocode", "left_semi")
        sums = seen.groupBy("geocode", "scientificName", "taxonKey").agg(F.sum(F.coalesce("individualCount", F.lit(1))).cast("bigint").alias("count"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = occurrences.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals(spark, path: str) -> DataFrame:
    """(geocode, scientificName, taxonKey, count) over all batches so far."""
    return spark.read.parquet(path).groupBy("geocode", "scientificName", "taxonKey").agg(F.sum("count").alias("count"))
