"""A keyed table in folders by a hash bucket of its key, merged in place.

Plain Parquet has no MERGE. Here a batch of changes rewrites only the buckets that
its keys fall into, by dynamic partition overwrite; the files of all other buckets
stay as they are. The number of buckets belongs to the table's definition: it is
chosen once so that a bucket fits one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from talentscope.session import cut_lineage

BUCKET, PRESENT = "_bucket", "_present"


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str],
                 buckets: int):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self._stored = StructType([*schema.fields, StructField(PRESENT, BooleanType()),
                                   StructField(BUCKET, IntegerType())])

    def bucket_of(self, key: list[str] | None = None) -> Column:
        """The bucket of a row whose key columns are ``key`` (the table's own names if
        not given); keys are compared as text."""
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key or self.key]),
                      F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _put(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, BUCKET).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))

    def write(self, rows: DataFrame) -> BucketedTable:
        """The table's first contents."""
        self._put(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields],
                              F.lit(True).alias(PRESENT), self.bucket_of()))
        return self

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of some buckets only if given (a partition filter)."""
        rows = self.spark.read.schema(self._stored).parquet(self.path).filter(F.col(PRESENT))
        if buckets is not None:
            rows = rows.filter(F.col(BUCKET).isin(buckets))
        return rows.select(*self.schema.names)

    def touched(self, keys: DataFrame, key: list[str] | None = None) -> list[int]:
        """Buckets that a frame's keys fall into: at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket_of(key)).distinct().collect())

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame],
              key: list[str] | None = None) -> list[int]:
        """Replaces the touched buckets' rows by ``apply(current rows, changes)`` and
        returns the buckets. The new rows are materialised before the overwrite, which
        therefore never reads what it replaces and may be repeated; a bucket that ends
        up empty keeps one marker row, so that its old rows go."""
        changes = cut_lineage(changes)
        touched = self.touched(changes, key)
        if not touched:
            return touched
        rows = apply(self.read(touched), changes).select(
            *[F.col(f.name).cast(f.dataType) for f in self.schema.fields],
            F.lit(True).alias(PRESENT)).withColumn(BUCKET, self.bucket_of())
        rows = cut_lineage(rows)
        empty = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").join(
            rows.select(BUCKET).distinct(), BUCKET, "left_anti")
        markers = empty.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields],
                               F.lit(False).alias(PRESENT), BUCKET)
        self._put(rows.unionByName(markers))
        return touched
