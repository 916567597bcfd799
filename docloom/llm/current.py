"""One row per key out of tables with copies and late versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The row of each key with the largest ``at``; null ``at`` sorts first, ties fall to a hash of the row.

    Aggregates on the map side first, so any number of copies of one key collapses before the shuffle.
    Rows with a null key are left out.
    """
    row = F.struct(*columns)
    order = F.struct(F.col(at), F.xxhash64(*columns))
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, order).alias("__row"))
    return picked.select(key, *[F.col(f"__row.{c}").alias(c) for c in columns])
