"""Shared helpers of the pipeline operators: inputs, staged tables, word classes."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.session import checkpoint_dir, drop_folder

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a Java regex class body.
WORD_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The top-level column of this very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


#: Lists that take note of what is staged while they are open.
_open_notes: list[list[str]] = []


@contextmanager
def noting():
    """A list of all folders and catalogue tables that are staged inside the block."""
    made: list[str] = []
    _open_notes.append(made)
    try:
        yield made
    finally:
        _open_notes.remove(made)


def noted(place: str) -> str:
    """Takes note of a folder, or of a table of the catalogue, that is about to be written."""
    for made in _open_notes:
        made.append(place)
    return place


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it: later jobs start from
    committed files, so a lost executor costs a re-read and not the whole chain."""
    spark = df.sparkSession
    path = noted(shared_path(spark, label))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what ``staged`` wrote for these frames: nothing reads them any more."""
    for df in frames:
        drop_folder(df.sparkSession, df.staged_path)


def discard_noted(spark: SparkSession, made: list[str], still_read: DataFrame) -> list[str]:
    """Removes noted folders and tables except those that ``still_read`` reads, which
    are returned; shuffle files that nothing refers to any more go as well."""
    files = [unquote(f) for f in still_read.inputFiles()] if made else []
    # names are unique; whole paths may be written in several ways (file:/ and file:///)
    kept = [place for place in made if any(f"/{place.rpartition('/')[2]}/" in f for f in files)]
    for place in made:
        if place in kept:
            continue
        if "/" in place:
            drop_folder(spark, place)
        else:
            spark.sql(f"drop table if exists {place}")
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return kept


def bucket_count(spark: SparkSession, total: float, per_bucket: float) -> int:
    """Buckets so that each holds about ``per_bucket`` units, never fewer than the
    session's shuffle partitions."""
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, int(total / per_bucket) + 1)


def crc_mod(col: Column, n: int) -> Column:
    """``crc32(id as text) mod n``; NULL for a NULL id."""
    return F.crc32(col.cast("string").cast("binary")) % n
