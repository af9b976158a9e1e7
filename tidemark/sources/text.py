"""Delimited text as a lazy frame."""

from __future__ import annotations

from pyspark.sql import DataFrame


def read_csv(path, index_col: str | list[str] | None = None, index_name: str | None = None, schema=None, spark=None, **options) -> DataFrame:
    """A lazy frame of one or many CSV files with a header.

    With ``schema`` (Spark's or its text) nothing is read beforehand; without
    it types are inferred, which takes a pass.  ``index_col`` (of a list, the
    first) comes first, named ``index_name`` if that's given.  Further options
    are those of Spark's CSV reader.
    """
    if spark is None:
        from ..store.catalog import get_client

        spark = get_client()
    reader = spark.read.options(**({"header": True} | options))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if index_col is not None:
        key = index_col if isinstance(index_col, str) else list(index_col)[0]
        df = df.select(f"`{key}`", *(f"`{c}`" for c in df.columns if c != key))
        if index_name:
            df = df.withColumnRenamed(key, index_name)
    return df
