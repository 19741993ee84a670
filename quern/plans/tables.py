"""The given tables as the library's own concepts, and the same views as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the whole texts of documents whose id is divisible by 100, as queries against all documents."""
    # A row of packs of texts and queries is several MB; Spark's 64 MB a batch are held several times over, in the JVM and in Python.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pixel: order number and line number as y and x, four scenes, seven bands and a QA mask."""
    # Long chains of pixel columns make methods beyond what HotSpot compiles; with its limit Spark evaluates them column by column.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x")).agg(
        F.max(F.col("l_orderkey") % 4).cast("string").alias("scene_id"),
        (F.lit(0.02) + F.max("l_tax")).alias("blue"), (F.lit(0.03) + F.max("l_tax")).alias("green"), (F.lit(0.02) + F.max("l_discount")).alias("red"),
        (F.lit(0.10) + F.max("l_quantity") / 100).alias("nir08"), (F.lit(0.05) + F.max("l_extendedprice") / 500000).alias("swir16"), (F.lit(0.03) + F.max("l_tax") * 2).alias("swir22"),
        (F.lit(280.0) + F.max("l_extendedprice") / 3000).alias("lwir11"), F.max(F.col("l_partkey") % 512).cast("int").alias("qa_pixel"),
    )


QUESTIONS = "q AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0)"

PIXELS = """px AS (
  SELECT l_orderkey AS y, l_linenumber AS x, CAST(max(l_orderkey % 4) AS VARCHAR) AS scene_id, 0.02 + max(l_tax) AS blue, 0.03 + max(l_tax) AS green,
         0.02 + max(l_discount) AS red, 0.10 + max(l_quantity) / 100 AS nir08, 0.05 + max(l_extendedprice) / 500000 AS swir16, 0.03 + max(l_tax) * 2 AS swir22,
         280.0 + max(l_extendedprice) / 3000 AS lwir11, CAST(max(l_partkey % 512) AS INTEGER) AS qa_pixel
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
