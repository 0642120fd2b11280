"""Streams: near-real-time upserts into an index's log, and fixed event-time windows with a bound on lateness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(rows: DataFrame, time_column: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts by `keys` and window, of a table or of a stream; on a stream rows later than `late` are left out."""
    c = F.col(time_column).cast("timestamp")
    rows = rows.withColumn("__time", c)
    if late:
        rows = rows.withWatermark("__time", late)
    return rows.groupBy(*keys, F.window("__time", width).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def newest_of_batch(batch: DataFrame) -> DataFrame:
    """The last write of each `_id` in a batch, by `_seq_no`."""
    w = Window.partitionBy("_id").orderBy(F.col("_seq_no").desc())
    return batch.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def refresh(stream: DataFrame, log_path: str, checkpoint: str, every: str = "1 second", once: bool = False, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Appends each micro-batch's newest writes to the log: readers see them with the next search.

    The batch id names the folder that a batch is written to, so a batch that is
    repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest_of_batch(batch).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        if after:
            after(batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
