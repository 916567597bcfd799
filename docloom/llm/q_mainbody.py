"""Problem 6: the main body of scraped pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.current import latest
from docloom.llm.mainbody import main_lines
from docloom.storage import table


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    texts = latest(table(spark, sf, "scraped_documents"), "page_id", "loaded_at", ["title", "text"])
    markup = latest(table(spark, sf, "scrape_requests").where("html is not null"), "page_id", "loaded_at", ["html"])
    return texts.join(markup, "page_id", "left")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return main_lines(_pages(spark, sf))


def p6_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's main body as text."""
    pages = _pages(spark, sf).where("text is not null")
    kept = main_lines(pages).groupBy("page_id").agg(F.collect_set("line_no").alias("keep"))
    body = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: F.array_contains("keep", i)), "\n")
    return pages.join(kept, "page_id", "left").select("page_id", F.coalesce(body, F.lit("")).alias("text"))


QUERIES = {"p6_found": p6_found, "p6_text": p6_text}
SQL = {}
