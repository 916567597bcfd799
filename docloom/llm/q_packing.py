"""Problem 7: texts packed into containers of 4,096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.packing import CAPACITY, pack
from docloom.llm.tokens import with_tokens
from docloom.storage import table


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack(with_tokens(table(spark, sf, "documents"), ["doc_id"]).withColumnRenamed("doc_id", "key"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that lie in more than one container: nothing else is split."""
    boxes = _packed(spark, sf).groupBy("key").agg(F.count_distinct("container").alias("n"))
    return boxes.where("n > 1").selectExpr("key as doc_id")


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Container and position of every text or piece."""
    return _packed(spark, sf).selectExpr("key as doc_id", "piece_no", "start_token", "tokens", "container", "position")


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How well the containers are filled, by tenths of a percent left unused."""
    boxes = _packed(spark, sf).where("container is not null").groupBy("container").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    unused = F.ceil((1 - F.col("used") / CAPACITY) * 1000).cast("int").alias("unused_permille")
    return boxes.groupBy(unused).agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"))


def p7_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Per text, sized in characters as SQL can: its pieces and size, and whether its containers keep every capacity."""
    sized = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))
    items = pack(sized, 4 * CAPACITY, 64, 100_000_000)
    place = Window.partitionBy("container")
    cost = F.sum(F.col("tokens").cast("double") ** 2).over(place)
    n = F.count(F.lit(1)).over(place)
    kept = (F.sum("tokens").over(place) <= 4 * CAPACITY) & (n <= 64) & ((cost <= 1e8) | (n == 1)) & (F.max("position").over(place) == n - 1)
    checked = items.withColumn("kept", F.col("container").isNull() | kept)
    return checked.groupBy(F.col("key").alias("doc_id")).agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("size"), F.bool_and("kept").alias("kept"))


QUERIES = {"p7_whole": p7_whole, "p7_found": p7_found, "p7_pack": p7_pack, "p7_fill": p7_fill}
# no text lies near the limit, so its characters tell as well as its tokens (about five a token here, three at least)
SQL = {
    "p7_whole": "select doc_id, greatest(1, cast(ceil(coalesce(length(text), 0) / 16384.0) as bigint)) as pieces, coalesce(length(text), 0) as size, true as kept from documents",
    "p7_found": "select doc_id from documents where length(text) > 4096 * 4",
}
