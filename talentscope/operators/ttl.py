"""Result-cache replay with a fixed-anchor TTL: TTL-1..3.

Semantics (per cache key, requests in time order, ties by id): a miss stores
an entry stamped with the request time; a later request with
``now - stamp < ttl`` (strict) is a hit; a hit does not refresh the stamp;
the first request at or after ``stamp + ttl`` is the next miss and
re-anchors. An invalidation deletes the entry, so the next request is a miss.

So the misses ("anchors") of a key are its first request and then, from each
anchor, the first request at or after anchor + ttl: a chain along the
pointer ``nxt(r)`` = first request of the key at or after ``t(r) + ttl``.
This is not a session window (the anchor is fixed, not sliding).

One path serves keys of every size:

1. Requests are range-partitioned on (key, time, id), so a hot key is split
   however its requests bunch in time, and each finds its neighbours of the
   same key (across partition borders through one summary row per key and
   partition). A request without a predecessor less than one ttl older starts
   a segment and is always a miss. Most requests are alone in their segment and
   are settled by that.
2. Only inside segments of two requests and more is the chain needed:
   ``nxt`` by an as-of lookup over range partitions, then pointer doubling from
   the segment starts: with ``J_i = nxt^(2^i)``, round i adds ``J_i(A)`` to the
   misses ``A`` and squares the pointers. The loop stops once ``J`` is empty,
   after about log2(longest chain of a segment) rounds of two equi-joins, each
   checkpointed to cut the lineage.

A request without a time is a miss that stores nothing: it is split off first.
Keys, times and ids may be of any type; a ttl must be positive.

Invalidations (TTL-3) split a key's timeline into epochs: the epoch of a
request is the time of the last invalidation at or before it (an
invalidation at the same instant as a request comes first), found with the
same as-of lookup, and the epoch becomes part of the key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentscope.operators.asof import as_micros, next_at_or_after, with_neighbours
from talentscope.operators.joins import null_safe_join
from talentscope.session import cut_lineage

MICROS = 1_000_000


def _anchors(nxt: DataFrame, heads: DataFrame) -> DataFrame:
    """Ids on the chains that start at ``heads`` and follow ``nxt`` (id → nxt_id)."""
    jump = cut_lineage(nxt.filter(F.col("nxt_id").isNotNull())
                       .select(F.col("id"), F.col("nxt_id").alias("to")))
    anchors = cut_lineage(heads.select("id"))
    while not jump.isEmpty():
        reached = anchors.join(jump, "id").select(F.col("to").alias("id"))
        anchors = cut_lineage(anchors.unionByName(reached))
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut_lineage(a.join(b, F.col("a.to") == F.col("b.id"))
                           .select(F.col("a.id").alias("id"), F.col("b.to").alias("to")))
    return anchors


def miss_positions(t: np.ndarray, ttl: int, start: int = 0) -> np.ndarray:
    """Positions of the misses in the sorted times ``t`` (no NULLs) when the first
    miss is at ``start``: the next miss is the first request at or after the last
    miss + ttl, so the loop runs once per miss, not once per request."""
    out = []
    i = start
    while i < len(t):
        out.append(i)
        i = int(np.searchsorted(t, t[i] + ttl, "left"))
    return np.asarray(out, dtype=np.int64)


def served_by_position(n: int, miss: np.ndarray) -> np.ndarray:
    """For each of ``n`` sorted requests, the index into ``miss`` of the miss
    that serves it (the last miss at or before it; -1 when none)."""
    return np.searchsorted(miss, np.arange(n), "right") - 1


def _chain(ev: DataFrame, heads: DataFrame, key_cols: list[str], ttl: int) -> DataFrame:
    """(id, hit, anchor_id) of requests in segments that begin at ``heads``."""
    probes = ev.select(*key_cols, "id", (F.col("_t") + F.lit(ttl)).alias("_pt"))
    nxt = next_at_or_after(probes, ev, key_cols, "_pt", "id", "_t", "id",
                           out_t="nxt_t", out_id="nxt_id").select("id", "nxt_id")
    # a pointer out of a segment leads to a segment's start, a miss already: cut
    # there, the chains of different segments never meet
    starts = heads.select(F.col("id").alias("nxt_id"))
    nxt = nxt.join(starts, "nxt_id", "left_anti")
    anchors = _anchors(nxt, heads).withColumn("_anchor", F.lit(True))
    flagged = ev.join(anchors, "id", "left").select("id", F.col("_anchor").isNull().alias("hit"))
    return flagged.join(_served_by(ev, anchors.select("id"), key_cols, ttl), "id", "inner")


def replay(requests: DataFrame, key_cols: list[str], ts_col: str, ttl_s: int,
           id_col: str = "id", with_anchor: bool = False, materialise: bool = True) -> DataFrame:
    """TTL-1 / TTL-2: every request with ``hit`` (served from the cache) or not
    (a miss, which stores a new entry). ``id_col`` must be unique and not NULL.
    With ``with_anchor``, ``anchor_id`` names the miss whose entry served the
    request (itself on a miss).

    The requests are read twice (the replay, then the output join). With
    ``materialise`` (the default) they are checkpointed first, so an expensive
    upstream plan runs once; pass ``False`` when they are a plain projection of
    a stored table or already materialised.
    """
    if ttl_s <= 0:
        raise ValueError("a ttl must be positive")
    ttl = int(ttl_s) * MICROS
    if materialise:
        requests = cut_lineage(requests)
    ev = requests.select(*key_cols, F.col(id_col).alias("id"),
                         as_micros(F.col(ts_col)).alias("_t"))
    timeless = ev.filter(F.col("_t").isNull()).select("id")
    near = cut_lineage(with_neighbours(ev.filter(F.col("_t").isNotNull()), key_cols, "_t", "id"))
    is_head = F.col("_before").isNull() | (F.col("_t") - F.col("_before") >= ttl)
    last = F.col("_after").isNull() | (F.col("_after") - F.col("_t") >= ttl)
    alone = near.filter(is_head & last).select("id").unionByName(timeless)
    dense = near.filter(~(is_head & last)).withColumn("_head", is_head)
    chained = _chain(dense.select(*key_cols, "id", "_t"), dense.filter("_head").select("id"),
                     key_cols, ttl)
    out = (alone.select("id", F.lit(False).alias("hit"), F.col("id").alias("anchor_id"))
           .unionByName(chained).withColumnRenamed("id", id_col))
    if not with_anchor:
        out = out.drop("anchor_id")
    return requests.join(out, id_col, "inner")


def _served_by(ev: DataFrame, anchor_ids: DataFrame, key_cols: list[str], ttl: int) -> DataFrame:
    """The anchor that served each request: the latest anchor of its key at or
    before it. Anchors lie at least one ttl apart, so a ttl-wide time chunk
    holds at most one, and a request is served from its own chunk or the one
    before: two equi-joins on (key, chunk), each with at most one match."""
    chunk = F.floor(F.col("_t") / ttl)
    anchors = (ev.join(anchor_ids, "id", "left_semi")
               .select(*key_cols, chunk.alias("_c"), F.col("id").alias("_aid"),
                       F.col("_t").alias("_at")))
    prev = anchors.select(*key_cols, (F.col("_c") + 1).alias("_c"),
                          F.col("_aid").alias("_pid"), F.col("_at").alias("_pt"))
    reqs = ev.select(*key_cols, "id", "_t", chunk.alias("_c"))
    both = null_safe_join(null_safe_join(reqs, anchors, [*key_cols, "_c"], "left"),
                          prev, [*key_cols, "_c"], "left")
    same = F.col("_aid").isNotNull() & (F.col("_at") <= F.col("_t"))
    return both.select("id", F.when(same, F.col("_aid")).otherwise(F.col("_pid")).alias("anchor_id"))


def epochs(requests: DataFrame, resets: DataFrame, key_cols: list[str], ts_col: str,
           reset_ts_col: str, id_col: str = "id") -> DataFrame:
    """Tag each request with ``epoch`` = time (µs) of the last reset of its key
    at or before it (-1 when none)."""
    r = requests.filter(F.col(ts_col).isNotNull()).select(
        *key_cols, F.col(id_col).alias("_rid"),
                        (-as_micros(F.col(ts_col))).alias("_neg_t"))
    s = resets.select(*key_cols, (-as_micros(F.col(reset_ts_col))).alias("_neg_t"),
                      F.lit(None).cast(requests.schema[id_col].dataType).alias("_sid"))
    # last reset ≤ t  ==  first (by negated time) reset with -time ≥ -t
    last = next_at_or_after(r, s, key_cols, "_neg_t", "_rid", "_neg_t", "_sid",
                            out_t="_neg_reset", out_id="_reset_id")
    tagged = last.select(F.col("_rid").alias(id_col),
                         F.coalesce(-F.col("_neg_reset"), F.lit(-1)).alias("epoch"))
    return (requests.join(tagged, id_col, "left")
            .withColumn("epoch", F.coalesce("epoch", F.lit(-1).cast("long"))))


def replay_with_resets(requests: DataFrame, resets: DataFrame, key_cols: list[str],
                       ts_col: str, reset_ts_col: str, ttl_s: int,
                       id_col: str = "id") -> DataFrame:
    """TTL-3: replay where a reset of the key deletes its entry."""
    tagged = cut_lineage(epochs(requests, resets, key_cols, ts_col, reset_ts_col, id_col))
    return replay(tagged, key_cols + ["epoch"], ts_col, ttl_s, id_col, materialise=False)
