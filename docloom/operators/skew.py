"""Joins that stay balanced when a few keys hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot when it holds at least this share of the rows, so there are at most 1 / share of them.
HOT_SHARE = 0.001
#: Below this many rows a key is no burden for one task at any size of the input.
HOT_ROWS = 20_000


def hot_keys(df: DataFrame, on: Sequence[str], share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame | None:
    """Keys holding at least ``share`` of the rows and ``least`` rows; None if there are none.

    Counts are combined on the map side; the result has at most ``1 / share`` rows by arithmetic,
    which is what makes broadcasting it safe at any input size.
    """
    some = F.lit(True)
    for c in on:
        some = some & F.col(c).isNotNull()
    total = df.where(some).count()
    if total < least:
        return None
    floor = max(least, share * total)
    counts = df.where(some).groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    rows = counts.where(F.col("__n") >= floor).select(*on).collect()
    return df.sparkSession.createDataFrame(rows, T.StructType([df.schema[c] for c in on])) if rows else None


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", salts: int = 32, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Equi-join of a possibly skewed ``left`` to a ``right`` that is unique by ``on``.

    Rows of hot keys are spread over ``salts`` tasks by a hash of the left row, and only the hot
    right rows are replicated. ``how``: inner, left, left_semi or left_anti. Null keys match nothing.
    """
    on = list(on)
    hot = hot_keys(left, on, share, least)
    if hot is None:
        return left.join(right, on, how)
    hot = hot.withColumn("__hot", F.lit(True))
    spread = F.pmod(F.xxhash64(*[c for c, t in left.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int")
    a = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__hot"), spread).otherwise(F.lit(0))).drop("__hot")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    b = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0))))).drop("__hot")
    return a.join(b, [*on, "__salt"], how).drop("__salt")
