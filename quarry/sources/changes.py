"""Writes as a log: the newest row of each `_id` is the document, older ones are its versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """Live documents of a log with `_id`, `_seq_no` and `_deleted`, and how often each was written as `_version`.

    One aggregate with partial states: a document written a million times moves
    one row per task.  A deletion counts as a version.
    """
    others = [c for c in log.columns if c not in ("_id", "_seq_no", "_deleted", "_version")]
    newest = F.max_by(F.struct("_seq_no", "_deleted", *others), "_seq_no").alias("newest")
    rows = log.groupBy("_id").agg(newest, F.count("*").alias("_version"))
    return rows.where(~F.col("newest._deleted")).select("_id", "newest._seq_no", "_version", *[F.col(f"newest.`{c}`") for c in others])
