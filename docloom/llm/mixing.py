"""Mixing sources to target weights.

Each source has to give ``target_share`` of the size of the whole corpus, and may be repeated
``max_repeats`` times. Its documents fall into blocks by a keyed hash; a source is drawn in whole
passes, then in a part of one more pass, cut to the document at which the target is reached.

Output shards get their parts by a splitting tree: the vector of block quotas (one entry per source)
is split between the two halves of the shards by a multivariate hypergeometric draw, recursively, so
every shard is a random sample of the mix and the quotas are used up exactly. Each source's blocks
are permuted, and the shards take disjoint runs of the permutation; within its shard a document's
position is a local shuffle.

The driver sees block sums only: at most ``MAX_SUMS`` numbers, whatever the input (a source has
``BLOCKS`` blocks, fewer if there are very many sources). Where blocks go is laid out on the
executors, one row of the plan per source. The block in which a target is reached is cut in the order
of a hash: sums of its 4,096 buckets tell in which bucket, and that one alone is sorted.

``reached`` is told from what was drawn.

Defined results: source names are compared trimmed and without letter case; of a source
named more than once the largest share counts; null texts have size 0;
equal texts under different ids all count; a target source without documents is reported as short;
with no documents at all nothing is drawn and nothing is short, as every target is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import SPACE_CHARS
from docloom.storage import Staging

#: Blocks per source; a parameter of the method, not of the data.
BLOCKS = 1024
MAX_SUMS = 1 << 22
#: Plans of the mix with more rows than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST = 200_000
#: Buckets of the block in which a source's target is reached.
BUCKETS = 4096
SHARD_TOKENS = 1 << 28
REPORT = "source string, target_share double, max_repeats int, documents long, available_tokens long, target_tokens double, repeats double, drawn_tokens long, actual_share double, mix_share double, reached boolean"


def source_name(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(SPACE_CHARS)))


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Splits block quotas among shards; the rows (shards) add up to the quotas exactly."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def divide(low: int, high: int, q: np.ndarray) -> None:
        if high - low == 1:
            out[low] = q
            return
        middle = (low + high) // 2
        take = int(round(int(q.sum()) * (middle - low) / (high - low)))
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if take else np.zeros_like(q)
        divide(low, middle, left)
        divide(middle, high, q - left)

    divide(0, shards, np.asarray(quotas, np.int64))
    return out


PLACES = "source string, block int, repeat_no int, shard int, upto double"


def _lay_out(shards: int):
    """Plan rows (source, blocks, whole, quota, upto, seed, per_shard) to the places of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rng = np.random.default_rng(r["seed"])
                order = rng.permutation(r["blocks"])
                shard_of = np.repeat(np.arange(shards, dtype=np.int32), r["per_shard"])
                mixed = rng.permutation(r["quota"])  # which run of the permutation a drawn block lies in
                for a in range(0, r["quota"], 1 << 16):
                    at = np.arange(a, min(r["quota"], a + (1 << 16)))
                    repeat, block = at // r["blocks"], order[at % r["blocks"]]
                    cut = np.full(len(at), r["upto"] is not None) & (at == r["quota"] - 1)
                    upto = np.where(cut, r["upto"] or 0.0, np.nan)
                    yield pa.RecordBatch.from_arrays([pa.array([r["source"]] * len(at)), pa.array(block, pa.int32()), pa.array(repeat, pa.int32()), pa.array(shard_of[mixed[at]]), pa.array(upto, mask=~cut)], ["source", "block", "repeat_no", "shard", "upto"])

    return run


class Mix:
    """The plan of a mix: ``report`` (one row per target source) and ``draws`` (one row per copy)."""

    def __init__(self, sized: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = 17, staging: Staging | None = None):
        """``sized``: key long, source string, tokens long. ``targets``: source, target_share, max_repeats.

        ``shards`` defaults to one for each ``SHARD_TOKENS``, 16 at least, and 16 blocks a shard.
        """
        self.spark = sized.sparkSession
        self.seed = seed
        self.staging = staging or Staging(self.spark, "mixing")
        # one row per target, a configuration: it is the report's size
        self.targets = sorted(targets.where("source is not null").select("source", source_name(F.col("source")).alias("name"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).distinct().collect())
        self.targets = sorted({r["name"]: r for r in sorted(self.targets, key=lambda r: (r["target_share"], r["max_repeats"]))}.values())
        self.blocks = max(1, min(BLOCKS, MAX_SUMS // max(1, len(self.targets))))
        block = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(self.blocks)).cast("int")
        self.sized = self.staging.put(sized.where("key is not null").select("key", source_name(F.col("source")).alias("source"), "tokens", block.alias("block")).distinct())
        self._plan(shards)

    def _plan(self, shards: int | None) -> None:
        total = self.sized.agg(F.sum("tokens")).first()[0] or 0
        names = self.spark.createDataFrame([(r["name"],) for r in self.targets], "source string").distinct()
        blocks = self.sized.join(names, "source").groupBy("source", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        sums = {r["name"]: np.zeros((self.blocks, 2), np.int64) for r in self.targets}
        for r in blocks:
            sums[r["source"]][r["block"]] = r["t"] or 0, r["n"]
        rng = np.random.default_rng(self.seed)
        self.rows, plans, quotas = [], [], []
        for r in self.targets:
            own = sums[r["name"]]
            have, target, most = int(own[:, 0].sum()), r["target_share"] * total, int(r["max_repeats"])
            short = have * most < target
            whole, rest = (most, 0.0) if short or not have else (int(target // have), target - have * int(target // have))
            seed = int(rng.integers(1 << 62))
            filled = np.cumsum(own[np.random.default_rng(seed).permutation(self.blocks), 0])
            part = min(int(np.searchsorted(filled, rest, "left")), self.blocks - 1) if rest > 0 else 0  # whole blocks of the last pass
            upto = rest - (int(filled[part - 1]) if part else 0) if rest > 0 else None  # then documents of one more block
            quota = (self.blocks * whole + part + (rest > 0)) if have else 0
            quotas.append(quota)
            plans.append((r["name"], self.blocks, whole, quota, upto, seed))
            self.rows.append((r, int(own[:, 1].sum()), have, target, total))
        if shards is None:
            shards = max(16, min(total // SHARD_TOKENS, sum(quotas) // 16))
        per_shard = split_quotas(np.array(quotas, np.int64), shards, rng) if sum(quotas) else np.zeros((shards, len(quotas)), np.int64)
        plans = [(*p, per_shard[:, s].tolist()) for s, p in enumerate(plans) if quotas[s]]
        plan = self.spark.createDataFrame(plans, "source string, blocks int, whole long, quota long, upto double, seed long, per_shard array<long>")
        self.places = plan.repartition(max(1, min(len(plans), 1000))).mapInArrow(_lay_out(shards), PLACES)
        self.broadcast = sum(quotas) <= MAX_BROADCAST

    def draws(self) -> DataFrame:
        """key, source, tokens, repeat_no, shard, position: one row per drawn copy of a document."""
        drawn = self.sized.join(F.broadcast(self.places) if self.broadcast else self.places, ["source", "block"])
        both = drawn.where("upto is null").drop("upto", "block").unionByName(self._cut(drawn.where("upto is not null")))
        local = F.xxhash64("key", "repeat_no", F.lit(self.seed + 2))
        slot = Window.partitionBy("shard", "__bucket").orderBy(local, "key", "repeat_no")
        # a bucket of the local order bounds each sort; its offset comes from the bucket counts
        both = both.withColumn("__bucket", F.pmod(F.shiftrightunsigned(local, 40), F.lit(256)).cast("int"))
        counts = both.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        placed = both.withColumn("rank", F.row_number().over(slot)).join(offsets, ["shard", "__bucket"])
        return placed.select("key", "source", "tokens", "repeat_no", "shard", (F.col("rank") - 1 + F.col("offset")).alias("position"))

    def _cut(self, last: DataFrame) -> DataFrame:
        """Of each source's last block the documents, in hash order, up to the one that reaches the target."""
        order = F.xxhash64("key", F.lit(self.seed + 1))
        last = self.staging.put(last.withColumn("__h", order).withColumn("__bucket", F.pmod(F.shiftrightunsigned("__h", 40), F.lit(BUCKETS)).cast("int")))
        before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = last.groupBy("source", "__bucket").agg(F.sum("tokens").alias("t"))
        sums = sums.withColumn("__before", F.coalesce(F.sum("t").over(before), F.lit(0)))
        rows = last.join(sums, ["source", "__bucket"]).where(F.col("__before") < F.col("upto"))
        columns = ["key", "source", "tokens", "repeat_no", "shard"]
        crossing = F.col("__before") + F.coalesce("t", F.lit(0)) >= F.col("upto")
        inside = Window.partitionBy("source", "__bucket").orderBy("__h", "key").rowsBetween(Window.unboundedPreceding, -1)
        some = rows.where(crossing).withColumn("__sum", F.col("__before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).where(F.col("__sum") < F.col("upto"))
        return rows.where(~crossing).select(columns).unionByName(some.select(columns))

    def report(self) -> DataFrame:
        """What each target source gives: repeats, drawn tokens, its share of the corpus and of the mix."""
        drawn = {r["source"]: r["t"] or 0 for r in self.draws().groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
        whole = sum(drawn.values()) or 1
        rows = []
        for r, docs, have, target, total in self.rows:
            got = int(drawn.get(r["name"], 0))
            reached = got >= target * (1 - 1e-12)
            rows.append((r["source"], r["target_share"], r["max_repeats"], docs, have, float(target), got / have if have else 0.0, got, got / total if total else 0.0, got / whole, bool(reached)))
        return self.spark.createDataFrame(rows, REPORT)
