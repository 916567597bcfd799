"""References to records that do not exist.

``find_orphans`` checks a (possibly composite) foreign key against its target table and reports
every referring record whose target is deleted, missing or arrived later than the record itself.

References are grouped by their null mask (which key columns are null); each mask is anti-joined, on
its non-null columns only, to the targets that are present, not deleted and no later than the record.
What is left over is bad, and only that small rest is joined again to tell why. Match semantics:

* ``simple``: any null column means there is no reference (SQL's default);
* ``full``: all columns null means none, some null is itself a violation (``incomplete``);
* ``partial``: the non-null columns must agree with at least one such target.

The reason is ``deleted`` if a target that agrees is deleted, else ``missing`` if none is present,
else ``late``.

References and targets are written once in reduced form and then read by every join, so that hot
targets are split by the adaptive skew join.

Defined results: an empty source gives no rows; an empty target makes every reference ``missing``;
copies of a record count once and its arrival is the smallest of its rows (null if all are null,
which is never late); rows without a record key are told apart by their references; a record with
several different references is reported once a reason; columns not named are ignored, whatever
they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.storage import Staging

MATCHES = ("simple", "full", "partial")
MAX_COLUMNS = 6


def referring(df: DataFrame, key: Column, refs: Sequence[Column], arrival: Column) -> DataFrame:
    """One row per record and distinct reference: __key, __r0.., __arrival (the record's smallest).

    Copies are combined before the shuffle; of the record's distinct references none is collected.
    """
    names = [f"__r{i}" for i in range(len(refs))]
    rows = df.select(key.alias("__key"), *[c.alias(n) for c, n in zip(refs, names)], arrival.alias("__arrival"))
    once = rows.groupBy("__key", *names).agg(F.min("__arrival").alias("__arrival"))
    record = Window.partitionBy("__key", F.when(F.col("__key").isNull(), F.xxhash64(*names)))
    return once.withColumn("__arrival", F.min("__arrival").over(record))


def target_states(targets: DataFrame, keys: Sequence[Column], arrival: Column, deleted: DataFrame | None = None, deleted_keys: Sequence[Column] = ()) -> DataFrame:
    """One row per present or deleted key of the target: __r0.., __target_arrival, __present, __deleted."""
    names = [f"__r{i}" for i in range(len(keys))]
    rows = targets.select(*[c.alias(n) for c, n in zip(keys, names)], arrival.alias("__target_arrival"), F.lit(True).alias("__present"), F.lit(False).alias("__deleted"))
    if deleted is not None:
        none = F.lit(None).cast(rows.schema["__target_arrival"].dataType)
        rows = rows.unionByName(deleted.select(*[c.alias(n) for c, n in zip(deleted_keys, names)], none.alias("__target_arrival"), F.lit(False).alias("__present"), F.lit(True).alias("__deleted")))
    return rows.groupBy(*names).agg(F.min("__target_arrival").alias("__target_arrival"), F.bool_or("__present").alias("__present"), F.bool_or("__deleted").alias("__deleted"))


def find_orphans(refs: DataFrame, states: DataFrame, width: int = 1, match: str = "simple", staging: Staging | None = None) -> DataFrame:
    """``refs`` from ``referring`` against ``states`` from ``target_states``.

    Returns record_key, arrival and reason (deleted, missing, late or incomplete), one row per
    record and reason.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if not 1 <= width <= MAX_COLUMNS:
        raise ValueError(f"a key has 1 to {MAX_COLUMNS} columns")
    staging = staging or Staging(refs.sparkSession, "references")
    refs, states = staging.put(refs), staging.put(states)
    names = [f"__r{i}" for i in range(width)]
    good = states.where("__present and not __deleted")
    on_time = F.coalesce(F.col("t.__target_arrival") <= F.col("r.__arrival"), F.lit(True))
    found = []
    for mask in product((True, False), repeat=width):  # True: the column is not null
        here = reduce(lambda a, b: a & b, [F.col(n).isNotNull() if m else F.col(n).isNull() for n, m in zip(names, mask)])
        part = refs.where(here)
        if not any(mask) or (match == "simple" and not all(mask)):
            continue
        if match == "full" and not all(mask):
            found.append(part.select("__key", "__arrival", F.lit("incomplete").alias("reason")))
            continue
        on = [n for n, m in zip(names, mask) if m]
        same = reduce(lambda a, b: a & b, [F.col(f"r.{n}") == F.col(f"t.{n}") for n in on])
        bad = staging.put(part.select("__key", "__arrival", *on).alias("r").join(good.select(*on, "__target_arrival").alias("t"), same & on_time, "left_anti"))
        # why: the keys that the rest refers to, and the states of the targets that agree with them
        agree = states.join(bad.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.bool_or("__present").alias("__present"), F.bool_or("__deleted").alias("__deleted"))
        reason = F.when(F.col("__deleted"), F.lit("deleted")).when(~F.coalesce("__present", F.lit(False)), F.lit("missing")).otherwise(F.lit("late"))
        found.append(bad.join(agree, on, "left").select("__key", "__arrival", reason.alias("reason")))
    rows = reduce(lambda a, b: a.unionByName(b), found)
    return rows.select(F.col("__key").alias("record_key"), F.col("__arrival").alias("arrival"), "reason").distinct()
