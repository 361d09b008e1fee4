"""SRC-3 / SRC-4: JSON payload decode against a schema, and JSON encode / write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "corrupt_record"


def decode_json(df: DataFrame, column: str, schema: T.StructType,
                keep: list[str] | None = None) -> DataFrame:
    """Parse ``column`` into ``decoded`` (PERMISSIVE: a malformed payload gives
    NULL fields and its text in ``corrupt_record``; an empty or missing
    payload decodes as ``{}``)."""
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    payload = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("{}"))
    parsed = F.from_json(payload, with_corrupt,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    decoded = F.struct(*[parsed.getField(f.name).alias(f.name) for f in schema.fields])
    return df.select(*(keep or []), decoded.alias("decoded"),
                     parsed.getField(CORRUPT).alias(CORRUPT))


def encode_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink (one file per partition, no driver collect)."""
    df.write.mode(mode).json(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """SNK-1 sink: append rows to a parquet table folder."""
    df.write.mode("append").parquet(path)
