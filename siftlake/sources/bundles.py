"""Whole documents: one to a file, or many to a file in a bundle.

A tool that leaves a file for each finding or lane leaves millions of them, and each takes a block on disk, an entry in a listing and an
opening. A bundle holds the same documents as rows (path, content) of a Parquet table, whose name ends in `.parquet`; Spark writes and
reads it by parts of bounded size, whatever the number of documents. Readers take either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENDING = ".parquet"


def is_bundle(path: str) -> bool:
    return path.rstrip("/").endswith(ENDING)


def write(documents: DataFrame, path: str) -> str:
    """Write documents (path, content) as a bundle and return its path."""
    if not is_bundle(path):
        raise ValueError(f"the name of a bundle ends in {ENDING}: {path}")
    documents.select("path", F.col("content").cast("string").alias("content")).write.parquet(path)
    return path


def texts(spark: SparkSession, path: str) -> DataFrame:
    """`value`, the text of each document of a bundle, or of each file of a path."""
    if is_bundle(path):
        return spark.read.schema("path string, content string").parquet(path).select(F.coalesce("content", F.lit("")).alias("value"))
    return spark.read.text(path, wholetext=True).select("value")
