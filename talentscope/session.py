"""Spark session settings and the shared checkpoint folder.

Every job in this package is a plain DataFrame plan; the settings here are the
ones the plans rely on: UTC session time, ANSI mode, AQE with skew-join
splitting, and no web UI.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what is known small: AQE re-plans a sort-merge join into a
    # broadcast join when the *measured* build side is below this size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "talentscope", extra: dict | None = None) -> SparkSession:
    """Session for tests, bench and local runs; cluster jobs pass their own conf."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf[SPREAD_KEY] = str(shuffle_partitions)   # the test tables are single files
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage; a local session
    without the setting gets a fresh scratch folder (tests only).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        configured = tempfile.mkdtemp(prefix="talentscope-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: materialises ``df`` in the shared folder.

    Used where a plan is read twice and both reads must see the very same rows
    (ordinals over a range-partitioned sort), and to cut long iterative lineage.
    Survives executor loss, unlike a local checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, whichever file system holds it; none if it
    does not exist."""
    fs, place = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)
                  if s.isDirectory()) if fs.exists(place) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote."""
    fs, place = _folder(spark, path)
    fs.delete(place, True)


#: Setting: partitions to deal rows to before CPU-heavy per-row work.
SPREAD_KEY = "spark.talentscope.spreadPartitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows by ``keys`` to as many partitions as ``SPREAD_KEY`` names, before
    CPU-heavy per-row work (parsing, tokenising whole texts). Without the setting
    the plan relies on the file splits, as large tables allow."""
    n = df.sparkSession.conf.get(SPREAD_KEY, None)
    return df.repartition(int(n), *keys) if n else df
