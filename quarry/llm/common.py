"""What the operators share: their tables, sizes, free column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ship
from quarry.sources.tables import drop, saved, scratch, shared_dir, written

__all__ = ["drop", "fresh", "saved", "scratch", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built on `names` that `df` doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
