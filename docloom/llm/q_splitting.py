"""Problem 3: oversized texts cut into pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.current import latest
from docloom.llm.splitting import split_oversized
from docloom.storage import table

LIMIT, OVERLAP = 128, 16


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    pages = latest(table(spark, sf, "scraped_documents"), "page_id", "loaded_at", ["text"])
    return split_oversized(pages.withColumnRenamed("page_id", "key"), LIMIT, OVERLAP)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).where("piece_no = 0").selectExpr("key as page_id", "cut")


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece: its id (document:index), place in the text, tokens and own text."""
    return _pieces(spark, sf).selectExpr("piece_id as chunk_id", "key as page_id", "piece_no", "start_token", "end_token", "start_char", "end_char", "tokens", "text")


def p3_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Per split page: its tokens, and whether its pieces keep limit and overlap, cover it and hold its own text."""
    pieces = _pieces(spark, sf)
    pages = latest(table(spark, sf, "scraped_documents"), "page_id", "loaded_at", ["text"]).select(F.col("page_id").alias("key"), F.col("text").alias("whole"))
    same = F.col("text") == F.substring("whole", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    checked = pieces.join(pages, "key").withColumn("same", same).withColumn("before", F.lag("end_token").over(Window.partitionBy("key").orderBy("piece_no")))
    joined = F.coalesce(F.col("start_token") == F.col("before") - OVERLAP, F.col("start_token") == 0)
    fits = (F.col("tokens") <= LIMIT) & (F.col("tokens") == F.col("end_token") - F.col("start_token")) & (F.col("tokens") > OVERLAP)
    return checked.groupBy(F.col("key").alias("page_id")).agg(F.max("end_token").alias("n_tokens"), F.bool_and(joined & fits & F.col("same")).alias("kept"))


_WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BREAK = r"\n\r\x0b\f\x{85}\x{2028}\x{2029}"

QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_bounds": p3_bounds}
SQL = {
    "p3_bounds": rf"""
with pages as (select page_id, any_value(text) as text from scraped_documents where text is not null group by 1)
select page_id, n_tokens::int as n_tokens, true as kept from (select page_id, len(regexp_extract_all(text, '[^{_WS}]+')) as n_tokens from pages) where n_tokens > 128""",
    "p3_found": rf"""
with pages as (select page_id, any_value(text) as text from scraped_documents where text is not null group by 1),
sized as (select page_id, text, len(regexp_extract_all(text, '[^{_WS}]+')) as n from pages),
parts as (select page_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?…。！？])([{_WS}])', '\1' || chr(10) || '\2', 'g'), '[{_BREAK}]+')) as part from sized where n > 128)
select page_id, case when max(len(regexp_extract_all(part, '[^{_WS}]+'))) > 128 then 'forced' else 'natural' end as cut from parts group by 1"""
}
