"""SRC-1: typed scans of the stored tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from talentscope import schemas as S


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with the declared schema (no inference, pruning and
    pushdown left to Catalyst)."""
    reader = spark.read
    schema = S.TABLE_SCHEMAS.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(table_path(sf_dir, name))


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).events`` is a scan DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)
