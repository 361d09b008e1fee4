"""Registered streaming queries (STR-1..3); each runs its stream to completion
(availableNow) and returns the sink read back."""

from __future__ import annotations

from talentscope.plans.cache_queries import CACHE_REQS, _recursive
from talentscope import schemas as S
from talentscope.plans.oracle_bindings import with_ctes
from talentscope.plans.registry import register
from talentscope.sources.bindings import Domain
from talentscope.streaming import jobs


# STR-1 emits a day once the watermark (latest event time in milliseconds, as
# Spark tracks it, minus one day) has passed the day's end
STREAM_DAILY_SQL = with_ctes(["search_logs"], {}, """
select cast(date_trunc('day', created_at) as timestamp) as day, count(*) as search_count,
  count(distinct user_id) as unique_users, round(avg(tokens_used), 6) as avg_tokens,
  round(avg(latency_ms), 6) as avg_latency,
  round(cast(sum(case when cache_hit then 1 else 0 end) as double) / count(*) * 100, 6) as cache_hit_rate
from search_logs group by 1
having epoch_ms(cast(date_trunc('day', created_at) as timestamp) + interval 1 day)
       <= (select epoch_ms(max(created_at)) from search_logs) - 86400000""")


@register("stream_daily_metrics", STREAM_DAILY_SQL)
def q_stream_daily_metrics(spark, sf_dir):
    """STR-1: the closed days of the event stream, with exact distinct users."""
    return jobs.run_daily_metrics(spark, sf_dir)


@register("stream_cache_replay", _recursive(["search_logs"], CACHE_REQS, S.SEARCH_CACHE_TTL_S,
                                            "r.id, r.user_id, r.key as cache_key, r.ts as requested_at, "
                                            "w.hit, w.anchor_id"))
def q_stream_cache_replay(spark, sf_dir):
    """STR-2: equal to the batch replay when batches arrive in time order."""
    return jobs.run_cache_replay(spark, sf_dir)


@register("stream_view_counts", with_ctes(["resumes", "resume_views"], {}, """
select r.id, r.name, r.email, count(v.id) as view_count
from resumes r join resume_views v on v.resume_id = r.id group by r.id, r.name, r.email"""))
def q_stream_view_counts(spark, sf_dir):
    """STR-3: all views so far (no trailing window on a stream)."""
    return jobs.run_view_counts(spark, sf_dir, Domain(spark, sf_dir).resumes())
