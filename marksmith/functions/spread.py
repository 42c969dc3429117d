"""Partitioning for walks in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` by ``key`` over as many partitions as shuffles have.

    Python's work on a group isn't in proportion to its bytes, so small partitions aren't to be put together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
