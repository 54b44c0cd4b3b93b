"""Tables and derived inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script segments: a conversation is a chapter, its turns are segments."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("chapter_idx"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text")


SEGMENTS_SQL = "segments AS (SELECT conv_id AS chapter_idx, turn AS seg_idx, role AS speaker, text FROM conversations)"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of documents with a dense ordinal."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).alias("para_idx", "text"))
    return t.withColumn("para_idx", F.col("para_idx").cast("long"))


PARAGRAPHS_SQL = """paragraphs AS (
  SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS para_idx
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ps FROM documents))"""


def by(*keys: str):
    return Window.partitionBy(*keys)
