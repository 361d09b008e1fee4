"""Batch = stream over ordered micro-batches, and physical-plan checks."""

import os
import tempfile

import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL
from talentscope.streaming import jobs


def split_events(n_parts: int) -> str:
    """Copy of the small events table cut into time-ordered files."""
    folder = tempfile.mkdtemp(prefix="talentscope-stream-")
    t = pq.read_table(os.path.join(SF_SMALL, "events.parquet"))
    t = t.take(pc.sort_indices(t, sort_keys=[("ts", "ascending"), ("event_id", "ascending")]))
    size = (t.num_rows + n_parts - 1) // n_parts
    for i in range(n_parts):
        path = os.path.join(folder, f"events-{i}.parquet")
        pq.write_table(t.slice(i * size, size), path)
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    return folder


def test_stream_cache_replay_equals_batch_over_micro_batches(spark):
    folder = split_events(3)
    streamed = jobs.run_cache_replay(spark, folder, glob="events-*.parquet")
    batch = E.queries()["cache_replay"](spark, SF_SMALL)
    cols = ["id", "hit", "anchor_id"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(
        map(tuple, batch.select(cols).collect()))


class _State:
    """Stand-in for GroupState: exists / get / update / timeout."""

    hasTimedOut = False

    def __init__(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, ms):
        self.ends = ms

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v


def test_stream_fold_equals_sequential_fold_across_batches():
    """The per-key stream fold (misses found by search, not a per-row loop)
    against a plain loop, over several batches with ties and TTL boundaries."""
    import random

    import pandas as pd
    rnd = random.Random(13)
    ttl = 10
    base = pd.Timestamp("2024-01-01")
    rows = sorted((rnd.randrange(0, 200), i) for i in range(300))
    rows += [(rows[7][0], 1000 + i) for i in range(3)]           # ties at one instant
    rows += [(rows[-1][0] + ttl, 2000), (rows[-1][0] + ttl - 1, 2001)]
    rows.sort()
    want, anchor = {}, None
    for t, rid in rows:
        if anchor is not None and t - anchor[0] < ttl:
            want[rid] = (True, anchor[1])
        else:
            anchor = (t, rid)
            want[rid] = (False, rid)
    fold = jobs._replay_fn(ttl * 1_000_000)
    state, got = _State(), {}
    for lo, hi in [(0, 40), (40, 41), (41, 200), (200, len(rows))]:
        part = rows[lo:hi]
        rnd.shuffle(part)
        pdf = pd.DataFrame({"id": [r for _, r in part], "user_id": 1, "cache_key": "k",
                            "requested_at": [base + pd.Timedelta(seconds=t) for t, _ in part]})
        for out in fold(("k",), iter([pdf]), state):
            got.update({r.id: (bool(r.hit), int(r.anchor_id)) for r in out.itertuples()})
    assert got == want


def test_stream_fold_of_many_keys_in_one_bucket_equals_a_loop():
    """One call folds all keys of a bucket; ended entries leave the state."""
    import random

    import pandas as pd
    rnd = random.Random(5)
    ttl, base = 10, pd.Timestamp("2024-01-01")
    rows = sorted((rnd.randrange(0, 120), i, rnd.choice(["a", "b", "c", None])) for i in range(400))
    want, live = {}, {}
    for t, rid, key in rows:
        if key in live and t - live[key][0] < ttl:
            want[rid] = (key, True, live[key][1])
        else:
            live[key] = (t, rid)
            want[rid] = (key, False, rid)
    fold = jobs._replay_fn(ttl * 1_000_000)
    state, got = _State(), {}
    for lo, hi in [(0, 3), (3, 150), (150, 151), (151, len(rows))]:
        part = rows[lo:hi]
        rnd.shuffle(part)
        pdf = pd.DataFrame({"id": [r for _, r, _ in part], "user_id": 1, "cache_key": [k for *_, k in part],
                            "requested_at": [base + pd.Timedelta(seconds=t) for t, *_ in part]})
        for out in fold((7,), iter([pdf.iloc[:1], pdf.iloc[1:]]), state):
            got.update({r.id: (None if pd.isna(r.cache_key) else r.cache_key, bool(r.hit), int(r.anchor_id))
                        for r in out.itertuples()})
    assert got == want
    assert sorted(map(str, state.get[0])) == ["None", "a", "b", "c"]
    state.getCurrentWatermarkMs = lambda: int((base.timestamp() + 115) * 1000)
    late = pd.DataFrame({"id": [900], "user_id": 1, "cache_key": ["d"],
                         "requested_at": [base + pd.Timedelta(seconds=130)]})
    list(fold((7,), iter([late]), state))
    assert set(state.get[0]) == {"d"} | {k for k, v in live.items() if v[0] + ttl > 115}


def test_stream_daily_metrics_closed_days_equal_batch(spark):
    """Three micro-batches: every closed day equals the batch metrics exactly,
    distinct users included."""
    folder = split_events(3)
    cols = ["search_count", "unique_users", "avg_tokens", "avg_latency", "cache_hit_rate"]
    streamed = {r["day"]: tuple(r[c] for c in cols) for r in
                jobs.run_daily_metrics(spark, folder, glob="events-*.parquet").collect()}
    logs = E.queries()["scan_search_logs"](spark, SF_SMALL)
    n = F.count(F.lit(1))
    batch = {r["day"]: tuple(r[c] for c in cols) for r in logs.groupBy(
        F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")).agg(
        n.alias("search_count"), F.count_distinct("user_id").alias("unique_users"),
        F.round(F.avg("tokens_used"), 6).alias("avg_tokens"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        F.round(F.count_if("cache_hit").cast("double") / n * 100, 6).alias("cache_hit_rate")).collect()}
    assert streamed and all(batch[d] == v for d, v in streamed.items())
    assert max(streamed) < max(batch)  # the last day is still open


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_pushes_the_window_filter_and_prunes_columns(spark):
    p = plan(E.entry(spark))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string" \
           ",value:double,props:string>" not in p


def test_no_cartesian_or_nested_loop_and_no_python_in_batch_plans(spark):
    q = E.queries()
    for key in ["visible_documents", "editable_documents", "criteria_match", "text_match_all",
                "most_viewed", "fk_violations", "derive_views"]:
        p = plan(q[key](spark, SF_SMALL))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                    "ArrowEvalPython", "FlatMapGroupsInPandas"):
            assert bad not in p, (key, bad)


def test_top_k_and_per_user_limit_strategies(spark):
    q = E.queries()
    assert "TakeOrderedAndProject" in plan(q["popular_searches"](spark, SF_MID))
    assert "WindowGroupLimit" in plan(q["recent_searches_per_user"](spark, SF_MID))
