"""Problem 8: sources mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.mixing import Mix, source_name
from docloom.llm.tokens import with_tokens
from docloom.storage import table


def _mix(spark: SparkSession, sf: str) -> Mix:
    sized = with_tokens(table(spark, sf, "documents"), ["doc_id", "source"]).withColumnRenamed("doc_id", "key")
    return Mix(sized, table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report().where("not reached").select("source")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats and actual shares of every target source."""
    return _mix(spark, sf).report()


def p8_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Every drawn copy of a document with its shard and place."""
    return _mix(spark, sf).draws().withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The mix of texts sized in characters as SQL can: what every source has, whether it reaches its target and is drawn right."""
    sized = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))
    mix = Mix(sized, table(spark, sf, "mix_targets"))
    largest = sized.groupBy(source_name(F.col("source")).alias("name")).agg(F.max("tokens").alias("largest"))
    copies = mix.draws().groupBy(F.col("source").alias("name"), "key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repeat_no").alias("d"))
    used = copies.groupBy("name").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.bool_and(F.col("n") == F.col("d")).alias("distinct"))
    rows = mix.report().withColumn("name", source_name(F.col("source"))).join(largest, "name", "left").join(used, "name", "left")
    over = F.col("drawn_tokens") - F.col("target_tokens")
    exact = F.when(F.col("reached"), (over > -1e-3) & (over < F.coalesce("largest", F.lit(0)) + 1)).otherwise(F.col("drawn_tokens") == F.col("available_tokens") * F.col("max_repeats"))
    fair = F.coalesce((F.col("most") <= F.col("max_repeats")) & F.col("distinct"), F.lit(True))
    return rows.select("source", "documents", "available_tokens", "reached", (exact & fair).alias("kept"))


QUERIES = {"p8_shares": p8_shares, "p8_found": p8_found, "p8_mix": p8_mix, "p8_draws": p8_draws}
# none lies near its target, so characters, of which a token has about as many in every source, tell as well as tokens
SQL = {
    "p8_shares": r"""
with t as (select distinct source, target_share, max_repeats from mix_targets),
d as (select lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as source, coalesce(length(text), 0) as n from documents),
s as (select source, sum(n)::bigint as n, count(*) as docs from d group by 1)
select t.source, coalesce(s.docs, 0) as documents, coalesce(s.n, 0) as available_tokens, coalesce(s.n, 0) * t.max_repeats >= t.target_share * (select sum(n) from d) as reached, true as kept
from t left join s on s.source = lower(trim(t.source))""",
    "p8_found": r"""
with t as (select distinct source, target_share, max_repeats from mix_targets),
d as (select lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as source, coalesce(length(text), 0) as n from documents),
s as (select source, sum(n) as n from d group by 1)
select t.source from t left join s on s.source = lower(trim(t.source)) where coalesce(s.n, 0) * t.max_repeats < t.target_share * (select sum(n) from d)"""
}
