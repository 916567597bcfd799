"""Problem 2: lines repeated across one site's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.current import latest
from docloom.llm.lines import host, repeated_lines, without_lines
from docloom.storage import table


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scraped_documents").select(F.col("page_id").alias("doc"), host(F.col("url")).alias("source"), "text")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines(_pages(spark, sf)).select(F.col("doc").alias("page_id"), "line_no")


def p2_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's text without its repeated lines."""
    pages = table(spark, sf, "scraped_documents").withColumn("source", host(F.col("url")))
    now = latest(pages, "page_id", "loaded_at", ["source", "text"]).withColumnRenamed("page_id", "doc")
    return without_lines(now.select("doc", "text"), repeated_lines(_pages(spark, sf))).withColumnRenamed("doc", "page_id")


_WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_FOUND = rf"""
with pages as (
  select distinct page_id, text, regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '^www\.', '') as site
  from scraped_documents where url is not null and text is not null),
sized as (select site, count(distinct page_id) as size from pages where site <> '' group by 1),
parts as (select page_id, site, string_split(text, chr(10)) as p from pages where site <> ''),
lines as (select page_id, site, unnest(p) as line, unnest(range(len(p))) as line_no from parts),
norm as (select page_id, site, line_no, regexp_replace(trim(regexp_replace(lower(line), '[{_WS}]+', ' ', 'g')), '[0-9]+', '0', 'g') as line from lines),
often as (select site, line from norm where line <> '' group by 1, 2 having count(distinct page_id) >= 4),
counted as (select site, line, count(distinct page_id) as n from norm where line <> '' group by 1, 2),
rep as (select c.site, c.line from counted c join sized s on c.site = s.site where c.n >= 4 and c.n >= 0.3 * s.size)
"""

QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
SQL = {
    "p2_found": _FOUND + "select distinct n.page_id, cast(n.line_no as int) as line_no from norm n join rep r on n.site = r.site and n.line = r.line",
    "p2_clean": _FOUND
    + """, cut as (select distinct n.page_id, n.line_no from norm n join rep r on n.site = r.site and n.line = r.line),
  every as (select page_id, any_value(text) as text from scraped_documents group by 1),
  places as (select page_id, list(line_no) as gone from cut group by 1)
  select e.page_id, case when p.gone is null then e.text else
    array_to_string(list_filter(string_split(e.text, chr(10)), lambda x, i: not list_contains(p.gone, i - 1)), chr(10)) end as text
  from every e left join places p on e.page_id = p.page_id""",
}
