"""Problem 9: subject areas of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.subjects import subjects_of
from docloom.storage import table


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    labels = table(spark, sf, "subject_labels").select(F.col("doc_id").alias("key"), "subject")
    return subjects_of(docs, table(spark, sf, "subject_areas"), labels).withColumnRenamed("key", "doc_id")


def p9_makeup(spark: SparkSession, sf: str) -> DataFrame:
    """The make-up of the corpus: documents per subject, and how many of them share it with others."""
    found = p9_found(spark, sf)
    per_doc = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(per_doc, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") > 1).alias("mixed"))


QUERIES = {"p9_found": p9_found, "p9_makeup": p9_makeup}
SQL = {}
