"""As-of lookups by time over range partitions.

``next_at_or_after`` finds, for every probe (key, time), the first target of
the same key at or after that time. Spark has no as-of join, and a window
over the whole key would put a hot key's rows in one task; a window over
(key, fixed time chunk) still would when a hot key bursts inside one chunk
(or many of its rows share one instant). So the split follows the data:

1. probes and targets are range-partitioned together on (key, time, kind,
   id) — Spark samples the boundaries, so a hot key, even one with all its
   rows at one instant, is spread over many partitions — and materialised
   once, so that the partition id is stable for the two reads below;
2. inside one (key, partition) a running ``last(ignorenulls)`` over the
   reversed order gives the nearest target at or after each probe (a
   (key, partition) group is never larger than one range partition);
3. a probe with no such target in its own partition takes the first target
   of the nearest later partition that holds one, from a per-(key,
   partition) summary (first target, last target, last probe): one row per
   partition a key touches, so at most the partition count per key, however
   many rows the key has.

Both windows use a growing frame (from unbounded preceding), which Spark
evaluates in one streaming pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentscope.operators.joins import null_safe_join
from talentscope.session import cut_lineage


def next_at_or_after(probes: DataFrame, targets: DataFrame, keys: list[str],
                     probe_t: str, probe_id: str, target_t: str, target_id: str,
                     parts: int | None = None, out_t: str = "next_t",
                     out_id: str = "next_id") -> DataFrame:
    """Probes with the (time, id) of the first target (by time, then id) of the
    same key whose time is ≥ the probe time; NULL when there is none.

    ``probe_t`` / ``target_t`` are integer times (e.g. epoch microseconds).
    ``parts``: number of range partitions (default: the session's shuffle
    partitions).
    """
    spark = probes.sparkSession
    n = int(parts or spark.conf.get("spark.sql.shuffle.partitions"))
    p = probes.select(*keys, F.col(probe_t).alias("_t"), F.col(probe_id).alias("_id"),
                      F.lit(0).alias("_kind"))
    t = targets.select(*keys, F.col(target_t).alias("_t"), F.col(target_id).alias("_id"),
                       F.lit(1).alias("_kind"))
    # ascending (key, time, kind, id): at equal time a probe sorts before the
    # targets, so "the first target after the probe" includes equal times
    ranged = cut_lineage(p.unionByName(t)
                         .repartitionByRange(n, *keys, "_t", "_kind", "_id")
                         .withColumn("_pid", F.spark_partition_id()))

    # 2. nearest target at or after the probe, inside the probe's partition
    within = (Window.partitionBy(*keys, "_pid")
              .orderBy(F.col("_t").desc(), F.col("_kind").desc(), F.col("_id").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = F.when(F.col("_kind") == 1, F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")))
    local = (ranged.withColumn("_near", F.last(hit, ignorenulls=True).over(within))
             .filter(F.col("_kind") == 0)
             .select(*keys, "_pid", F.col("_id").alias(probe_id), "_near"))

    # 3. first target of the nearest later partition of the same key, for the
    # (key, partition) groups whose last probe comes after their last target
    # (only those probes found nothing locally); one summary row per group
    pos = F.struct(F.col("_t").alias("t"), F.col("_kind").alias("k"), F.col("_id").alias("id"))
    is_target = F.col("_kind") == 1
    summary = ranged.groupBy(*keys, "_pid").agg(
        F.min(F.when(is_target, F.struct(F.col("_t").alias("t"), F.col("_id").alias("id"))))
        .alias("_first"),
        F.max(F.when(is_target, pos)).alias("_last_target"),
        F.max(F.when(~is_target, pos)).alias("_last_probe"))
    later = (Window.partitionBy(*keys).orderBy(F.col("_pid").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    is_open = F.col("_last_probe").isNotNull() & (
        F.col("_last_target").isNull() | (F.col("_last_probe") > F.col("_last_target")))
    fallback = (summary.withColumn("_later", F.last("_first", ignorenulls=True).over(later))
                .filter(is_open)
                .select(*keys, "_pid", "_later"))

    res = null_safe_join(local, fallback, [*keys, "_pid"], "left")
    best = F.coalesce(F.col("_near"), F.col("_later"))
    return res.select(*keys, probe_id, best["t"].alias(out_t), best["id"].alias(out_id))


def with_neighbours(rows: DataFrame, keys: list[str], t: str, row_id: str,
                    parts: int | None = None) -> DataFrame:
    """``rows`` with ``_before`` and ``_after``: the times of the previous and the
    next row of the same key in (time, id) order; NULL at the ends.

    Rows are range-partitioned on (key, time, id), so a hot key is spread over many
    partitions; a row at a border takes its neighbour from the summary of the
    key's adjacent partition (one row per key and partition it touches)."""
    n = int(parts or rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(rows.repartitionByRange(n, *keys, t, row_id)
                         .withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy(*keys, "_pid").orderBy(t, row_id)
    local = ranged.withColumns({"_lag": F.lag(t).over(w), "_lead": F.lead(t).over(w)})
    across = Window.partitionBy(*keys).orderBy("_pid")
    borders = (ranged.groupBy(*keys, "_pid").agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
               .withColumns({"_left": F.lag("_hi").over(across), "_right": F.lead("_lo").over(across)})
               .drop("_lo", "_hi"))
    # only the few (key, partition) groups with a neighbour elsewhere are needed
    borders = borders.filter(F.col("_left").isNotNull() | F.col("_right").isNotNull())
    return (null_safe_join(local, borders, [*keys, "_pid"], "left")
            .withColumns({"_before": F.coalesce("_lag", "_left"),
                          "_after": F.coalesce("_lead", "_right")})
            .drop("_lag", "_lead", "_left", "_right", "_pid"))


def as_micros(c: Column) -> Column:
    """Epoch microseconds of an NTZ timestamp in a UTC session."""
    return F.unix_micros(c.cast("timestamp"))
