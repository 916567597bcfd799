"""Filling fixed-capacity containers with items: vector best-fit.

An item uses three capacities of a container: tokens, one document, and attention cost (its tokens
squared, what a block-diagonal attention mask pays). Items go in order of falling size; among the
open containers with room in every dimension, each item takes the one with the smallest weighted
norm of what would be left (``norm``) or the largest weighted dot product of the item with what is
left now (``dot``), else a new one. An item above the token capacity is split into full pieces and
a rest; nothing else is split.

The attention cost of a container of full tokens is largest with one full item, capacity squared; so
that default can never bind, and a smaller ``max_cost`` does. An item whose own cost is above it is
not split (its tokens fit): it opens a container and leaves no room for another.

Items are spread over shards of about ``shard_tokens`` tokens and at most ``SHARD_ROWS`` items on
average by a hash, and each shard is packed by itself, so no task grows with the input. The items of
containers with room left in every dimension (below ``refill`` of each) are packed again over shards
of up to 16 times as many tokens and no more items, which removes the loss at the shards' edges.

Defined results: a null or empty text has size 0 and comes out with a null container and position;
repeated rows of an item count once; an empty table gives no rows; equal sizes go by key.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.storage import Staging

CAPACITY = 4096
#: Containers packed by one task at a time, 1,024 on average.
SHARD_TOKENS = CAPACITY * 1024
#: More shards than this share tasks.
MAX_TASKS = 20_000
#: Items packed by one task at a time, on average.
SHARD_ROWS = 100_000
PACKED = "key long, piece_no int, start_token long, tokens long, container string, position int, used long, full boolean"


def best_fit(sizes: np.ndarray, capacity: int, max_items: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm") -> np.ndarray:
    """Container number of each item; ``sizes`` in falling order, each at most ``capacity``.

    An item that costs more than ``max_cost`` opens a container and closes it.
    """
    out = np.empty(len(sizes), np.int64)
    caps = np.array([capacity, max_items, max_cost], np.float64)
    w = np.array(weights)
    left = np.empty((1024, 3))
    ids = np.empty(1024, np.int64)
    n = made = 0
    least = sizes[-1] if len(sizes) else 0
    for i, size in enumerate(sizes):
        need = np.array([size, 1.0, float(size) * size]) / caps
        alone = need[2] > 1
        if n and not alone:
            rest = left[:n] - need
            fits = (rest >= -1e-12).all(axis=1)
            if fits.any():
                score = (rest * rest) @ w if rule == "norm" else -(left[:n] @ (w * need))
                score[~fits] = np.inf
                k = int(score.argmin())
                out[i] = ids[k]
                left[k] -= need
                if left[k, 0] * capacity < least - 1e-6:  # nothing fits any more
                    n -= 1
                    left[k], ids[k] = left[n], ids[n]
                continue
        out[i] = made
        made += 1
        if alone:
            continue
        if n == len(left):
            left, ids = np.concatenate([left, np.empty_like(left)]), np.concatenate([ids, np.empty_like(ids)])
        left[n], ids[n] = 1.0 - need, made - 1
        n += 1
    return out


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(key, tokens) to (key, piece_no, start_token, tokens), items above the capacity in pieces."""
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0))
    cut = sized.select("key", F.col("tokens").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("p"))
    start = F.col("p") * capacity
    return cut.select("key", F.col("p").cast("int").alias("piece_no"), start.alias("start_token"), F.least(F.col("whole") - start, F.lit(capacity).cast("long")).alias("tokens"))


def _pack(items: DataFrame, shards: int, label: str, capacity: int, max_items: int, max_cost: int, weights, rule: str, refill: float) -> DataFrame:
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "key", "piece_no"], ascending=[False, True, True], ignore_index=True)
        sizes = pdf.tokens.to_numpy()
        box = best_fit(sizes, capacity, max_items, max_cost, weights, rule)
        used, items, cost = (np.bincount(box, x) for x in (sizes, np.ones(len(box)), sizes.astype(float) ** 2))
        full = (used >= refill * capacity) | (items >= max_items) | (cost >= refill * max_cost)
        pdf["container"] = [f"{label}{key[0]}-{b}" for b in box]
        pdf["position"] = pdf.groupby(box).cumcount().astype("int32")
        pdf["used"], pdf["full"] = used[box].astype("int64"), full[box]
        return pdf[["key", "piece_no", "start_token", "tokens", "container", "position", "used", "full"]]

    shard = F.pmod(F.xxhash64("key", "piece_no"), F.lit(shards))
    spread = items.select("key", "piece_no", "start_token", "tokens", shard.alias("__shard"))
    # the number of tasks is given, as the planner would put many small shards into one task
    return spread.repartition(min(shards, MAX_TASKS), "__shard").groupBy("__shard").applyInPandas(run, PACKED)


def _shards(items: DataFrame, tokens: int) -> int:
    size = items.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    return max(1, ceil((size["t"] or 0) / tokens), ceil(size["n"] / SHARD_ROWS))


def pack(sized: DataFrame, capacity: int = CAPACITY, max_items: int = 128, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm", shard_tokens: int = SHARD_TOKENS, refill: float = 0.97, staging: Staging | None = None) -> DataFrame:
    """``sized`` (key long, tokens long) to key, piece_no, start_token, tokens, container, position.

    ``max_cost`` defaults to ``capacity`` squared, the cost of one full item.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    max_cost = capacity * capacity if max_cost is None else max_cost
    if min(capacity, max_cost, max_items) < 1:
        raise ValueError("a container has room for something")
    staging = staging or Staging(sized.sparkSession, "packing")
    sized = staging.put(sized.where("key is not null").distinct())
    items = pieces(sized.where("tokens > 0"), capacity)
    rules = (capacity, max_items, max_cost, weights, rule, refill)
    first = staging.put(_pack(items, _shards(items, shard_tokens), "a", *rules))
    loose = first.where("not full")
    second = _pack(loose, _shards(loose, 16 * shard_tokens), "b", *rules)
    empty = sized.where("tokens is null or tokens <= 0").selectExpr("key", "0 as piece_no", "0L as start_token", "tokens", "cast(null as string) as container", "cast(null as int) as position")
    return first.where("full").unionByName(second).drop("used", "full").unionByName(empty)
