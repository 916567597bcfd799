"""Stateful operators over streams: change monitoring, token buckets, keep-last tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.ops import TokenBucket
from docloom.sources.tables import KeyedTable


def monitor(stream: DataFrame, key: str, body: str, at: str, tie: str) -> DataFrame:
    """Per key, whether each observation's digest differs from the one before; the state is that digest.

    Rows of one trigger are taken in time order; rows that arrive in a later trigger follow them,
    whatever their time. Bodies are digested before the shuffle.
    """
    kinds = dict(stream.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["at", "tie"])
        before = state.get[0] if state.exists else None
        shifted = [before, *rows.body_sha256.tolist()[:-1]]
        state.update((rows.body_sha256.iloc[-1],))
        yield pd.DataFrame({"key": [k[0]] * len(rows), "tie": rows.tie, "body_sha256": rows.body_sha256, "previous_sha256": shifted, "changed": [p is None or p != d for p, d in zip(shifted, rows.body_sha256)]})

    rows = stream.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.col(at).alias("at"), F.coalesce(F.sha2(F.col(body), 256), F.lit("")).alias("body_sha256"))
    out = rows.groupBy("key").applyInPandasWithState(step, f"key {kinds[key]}, tie {kinds[tie]}, body_sha256 string, previous_sha256 string, changed boolean", "digest string", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnsRenamed({"key": key, "tie": tie})


def rate_limit(stream: DataFrame, key: str, at: str, tie: str, rate: float = 10.0, burst: int = 20) -> DataFrame:
    """Each key's requests through its token bucket; the state is (last, tokens)."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["at", "tie"])
        bucket = TokenBucket(rate, burst, *(state.get if state.exists else ()))
        waits = [bucket.admit(t / 1e6) for t in rows["at"]]
        state.update((bucket.last, bucket.tokens))
        yield pd.DataFrame({"key": [k[0]] * len(rows), "tie": rows.tie, "wait_seconds": waits, "admitted": [w <= 0 for w in waits]})

    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    out = rows.groupBy("key").applyInPandasWithState(step, f"key {kinds[key]}, tie {kinds[tie]}, wait_seconds double, admitted boolean", "last double, tokens double", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnsRenamed({"key": key, "tie": tie})


def keep_last(stream: DataFrame, table: KeyedTable, checkpoint: str, **trigger: Any):
    """Merges every trigger's rows into a keyed table; repeated batches change nothing, new checkpoints lose nothing."""
    return stream.writeStream.foreachBatch(lambda df, n: table.merge(df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drop_repeats(stream: DataFrame, keys: list[str], at: str, within: str = "1 day") -> DataFrame:
    """Exact duplicates across triggers, as far back as the watermark reaches."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)
