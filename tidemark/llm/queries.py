"""The queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunking, forest, packing


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p3_found": lambda spark, d: forest.found(spark.read.parquet(f"{d}/append_calls.parquet")),
        "p6_ids": lambda spark, d: bpe.encode(_documents(spark, d)),
        "p7_containers": lambda spark, d: packing.pack(_documents(spark, d)),
        "p8_pieces": lambda spark, d: chunking.split_oversized(_documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    """None of these can be written in SQL; tests compare them with brute force."""
    return {}
