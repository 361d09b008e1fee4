"""Structured Streaming forms of three operators: STR-1..3.

* STR-1 daily metrics: event-time day windows with a one-day watermark,
  append mode (a day is emitted once closed). Distinct users are exact: a
  first windowed aggregate per (day, user) keeps counts and sums, a second
  one per day (over ``window_time`` of the first, Spark's chained window
  aggregation) counts its rows — exact distinct without a set in the state,
  and the means are Σ sums / Σ counts, as the batch ``avg`` computes them.
* STR-2 cache replay: ``applyInPandasWithState`` keyed by a hash bucket of the
  cache key, as a call and a state of their own for each key take longer than its
  few requests; the state holds the current anchor (time and id) of each key of
  the bucket whose entry has not ended, so a key costs a few bytes while it lives. Within a
  micro-batch a key's requests are sorted by (time, id) and folded — by search,
  once per miss (the next miss is the first request at or after the last miss +
  ttl), not once per request; across batches order is assumed (a late request is
  judged against the current anchor). A bucket's rows of one micro-batch meet in
  one task, so the micro-batch size (``maxFilesPerTrigger``) bounds that group.
* STR-3 view counts: stream–static join with the document table and an
  update-mode count per document, written by ``foreachBatch`` (each batch's
  changed counts, tagged by batch id; the latest per document is current).

Every job runs with ``trigger(availableNow=True)`` into a fresh folder under
the session's checkpoint directory (shared storage on a cluster), with its
own streaming checkpoint there, so a restarted job resumes exactly.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from talentscope import schemas as S
from talentscope.functions.text import search_cache_key
from talentscope.operators import ttl as TTL
from talentscope.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def event_stream(spark: SparkSession, sf_dir: str, max_files: int = 1,
                 glob: str = "events.parquet") -> DataFrame:
    """The events table as a file stream (one file per trigger)."""
    return (spark.readStream.schema(S.EVENTS)
            .option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files)
            .parquet(sf_dir))


def log_stream(events: DataFrame) -> DataFrame:
    """The search-log projection of the event stream (map-only)."""
    return events.select(
        F.col("event_id").alias("id"), "user_id",
        F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
         .when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), F.col("event_type")))
         .otherwise(F.upper("event_type")).alias("query"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("int"))
         .otherwise(F.regexp_extract("props", "[0-9]+", 0).cast("int")).alias("tokens_used"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        (F.col("event_type") == "view").alias("cache_hit"),
        F.col("ts").alias("created_at"))


def _run(df: DataFrame, sink: str, mode: str = "append", fmt: str = "parquet") -> None:
    q = (df.writeStream.outputMode(mode).format(fmt)
         .option("checkpointLocation", sink + "-checkpoint")
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()


# -- STR-1 --------------------------------------------------------------------

def daily_metrics_stream(logs: DataFrame, watermark: str = "1 day") -> DataFrame:
    # watermarks need a zoned timestamp; in a UTC session the cast is exact
    logs = logs.withColumn("event_time", F.col("created_at").cast("timestamp"))
    per_user = (logs.withWatermark("event_time", watermark)
                .groupBy(F.window("event_time", "1 day").alias("w"), "user_id")
                .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cache_hit")).alias("hits"),
                     F.sum("tokens_used").alias("tok_sum"), F.count("tokens_used").alias("tok_n"),
                     F.sum("latency_ms").alias("lat_sum"), F.count("latency_ms").alias("lat_n")))
    daily = (per_user.groupBy(F.window(F.window_time("w"), "1 day"))
             .agg(F.sum("n").alias("search_count"), F.count(F.lit(1)).alias("unique_users"),
                  F.sum("hits").alias("hits"), F.sum("tok_sum").alias("tok_sum"),
                  F.sum("tok_n").alias("tok_n"), F.sum("lat_sum").alias("lat_sum"),
                  F.sum("lat_n").alias("lat_n")))

    def mean(total, n):
        return F.round(F.try_divide(F.col(total).cast("double"), F.col(n)), 6)

    return daily.select(
        F.col("window.start").cast("timestamp_ntz").alias("day"), "search_count", "unique_users",
        mean("tok_sum", "tok_n").alias("avg_tokens"), mean("lat_sum", "lat_n").alias("avg_latency"),
        F.round(F.col("hits").cast("double") / F.col("search_count") * 100, 6).alias("cache_hit_rate"))


def run_daily_metrics(spark: SparkSession, sf_dir: str, glob: str = "events.parquet") -> DataFrame:
    sink = scratch(spark, "daily_metrics")
    _run(daily_metrics_stream(log_stream(event_stream(spark, sf_dir, glob=glob))), sink)
    return spark.read.parquet(sink)


# -- STR-2 --------------------------------------------------------------------

REPLAY_OUT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("cache_key", T.StringType()), T.StructField("requested_at", S.NTZ),
    T.StructField("hit", T.BooleanType()), T.StructField("anchor_id", T.LongType()),
])
REPLAY_STATE = T.StructType([T.StructField("cache_key", T.ArrayType(T.StringType())),
                             T.StructField("anchor_us", T.ArrayType(T.LongType())),
                             T.StructField("anchor_id", T.ArrayType(T.LongType()))])
#: Hash buckets of the cache keys; they belong to a stream's checkpoint.
REPLAY_BUCKETS = 4096


def _replay_fn(ttl_us: int):
    def fold(key, batches, state):
        if state.hasTimedOut:            # the watermark has passed every anchor + ttl: dead entries
            state.remove()
            return
        live = {k: (us, i) for k, us, i in zip(*state.get)} if state.exists else {}
        # the bucket's rows of this micro-batch may come in several chunks in no
        # particular order: sort them together (they are in this task anyway)
        frames = [f for f in batches if len(f)]
        if frames:
            pdf = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
            us = pdf["requested_at"].astype("datetime64[us]").astype("int64").to_numpy()
            codes, keys = pd.factorize(pdf["cache_key"], use_na_sentinel=False)
            order = np.lexsort((pdf["id"].to_numpy(), us, codes))
            pdf, codes, us = pdf.iloc[order], codes[order], us[order]
            ids = pdf["id"].to_numpy()
            hit, served = np.ones(len(us), dtype=bool), np.empty(len(us), dtype=np.int64)
            cuts = np.searchsorted(codes, np.arange(len(keys) + 1))
            for k, lo, hi in zip(keys, cuts[:-1].tolist(), cuts[1:].tolist()):
                k = None if pd.isna(k) else k
                t = us[lo:hi]
                anchor_us, anchor_id = live.get(k, (None, -1))
                first = 0 if anchor_us is None else int(np.searchsorted(t, anchor_us + ttl_us, "left"))
                served[lo:lo + first] = anchor_id
                miss = TTL.miss_positions(t, ttl_us, first) + lo
                if len(miss):
                    hit[miss] = False
                    # the entry serving a row is the last miss at or before it, else the state's
                    served[miss[0]:hi] = np.repeat(ids[miss], np.diff(miss, append=hi))
                    live[k] = (int(us[miss[-1]]), int(ids[miss[-1]]))
            yield pd.DataFrame({"id": ids, "user_id": pdf["user_id"].values,
                                "cache_key": pdf["cache_key"].values,
                                "requested_at": pdf["requested_at"].values,
                                "hit": hit, "anchor_id": served})
        # entries that ended before the watermark serve nothing any more
        now_us = state.getCurrentWatermarkMs() * 1000
        live = {k: v for k, v in live.items() if v[0] + ttl_us > now_us}
        if live:
            state.update((list(live), [us for us, _ in live.values()], [i for _, i in live.values()]))
            ends_ms = (max(us for us, _ in live.values()) + ttl_us) // 1000
            state.setTimeoutTimestamp(max(ends_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
    return fold


def cache_replay_stream(requests: DataFrame, ttl_s: int = S.SEARCH_CACHE_TTL_S,
                        buckets: int = REPLAY_BUCKETS) -> DataFrame:
    """``requests``: id, user_id, cache_key, requested_at (streaming). A key's entry is
    dropped once the watermark (a day behind) passes its end."""
    timed = (requests.withColumn("event_time", F.col("requested_at").cast("timestamp"))
             .withColumn("bucket", F.pmod(F.xxhash64("cache_key"), F.lit(buckets))))
    return timed.withWatermark("event_time", "1 day").groupBy("bucket").applyInPandasWithState(
        _replay_fn(int(ttl_s) * 1_000_000), REPLAY_OUT, REPLAY_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def run_cache_replay(spark: SparkSession, sf_dir: str, glob: str = "events.parquet") -> DataFrame:
    logs = log_stream(event_stream(spark, sf_dir, glob=glob))
    reqs = logs.select("id", "user_id",
                       search_cache_key(F.col("user_id"), F.col("query")).alias("cache_key"),
                       F.col("created_at").alias("requested_at"))
    sink = scratch(spark, "cache_replay")
    _run(cache_replay_stream(reqs), sink)
    return spark.read.parquet(sink)


# -- STR-3 --------------------------------------------------------------------

def view_stream(events: DataFrame, n_docs: int) -> DataFrame:
    return (events.filter(F.col("event_type").isin("view", "click"))
            .select(F.col("event_id").alias("id"),
                    ((F.col("event_id") * 31) % F.lit(n_docs)).alias("resume_id"),
                    "user_id", F.col("ts").alias("viewed_at")))


def run_view_counts(spark: SparkSession, sf_dir: str, resumes: DataFrame) -> DataFrame:
    """Current view count per document (documents without views absent)."""
    n_docs = resumes.count()
    # counted per id: a document that is renamed keeps its count; names are read last
    counts = (view_stream(event_stream(spark, sf_dir), n_docs)
              .groupBy("resume_id").agg(F.count("id").alias("view_count")))
    sink = scratch(spark, "view_counts")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink)

    q = (counts.writeStream.outputMode("update")
         .option("checkpointLocation", sink + "-checkpoint")
         .foreachBatch(upsert).trigger(availableNow=True).start())
    q.awaitTermination()
    written = spark.read.parquet(sink)
    latest = (written.groupBy(F.col("resume_id").alias("id"))
              .agg(F.max_by("view_count", "batch_id").alias("view_count")))
    return latest.join(resumes.select("id", "name", "email"), "id").select(
        "id", "name", "email", "view_count")
