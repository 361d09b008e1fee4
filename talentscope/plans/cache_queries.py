"""Registered cache-replay queries (TTL-1..3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.functions import text as TX
from talentscope.operators import ttl as TTL
from talentscope.plans.oracle_bindings import with_ctes
from talentscope.plans.registry import register
from talentscope.sources.bindings import Domain

TRIM = S.JS_TRIM_PATTERN


def _walk_sql(ttl_s: int, out_cols: str) -> str:
    """Recursive walk per key in (ts, id) order carrying the anchor (µs)."""
    ttl_us = int(ttl_s) * 1_000_000
    return f"""
base as (select *, epoch_us(ts) as us, row_number() over (partition by key order by ts, id) as rn from reqs),
walk as (
  select key, rn, id, us, us as anchor, id as anchor_id, false as hit from base where rn = 1
  union all
  select b.key, b.rn, b.id, b.us,
    case when b.us - w.anchor < {ttl_us} then w.anchor else b.us end,
    case when b.us - w.anchor < {ttl_us} then w.anchor_id else b.id end,
    b.us - w.anchor < {ttl_us}
  from walk w join base b on b.key = w.key and b.rn = w.rn + 1)
select {out_cols} from reqs r join walk w on w.id = r.id"""


def _recursive(bindings, reqs_sql: str, ttl_s: int, out_cols: str) -> str:
    body = with_ctes(bindings, {"reqs": reqs_sql}, "")
    return body.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + _walk_sql(ttl_s, out_cols)


CACHE_REQS = f"""select id, user_id, concat_ws(':', 'search', cast(user_id as varchar),
  regexp_replace(lower(query), '{TRIM}', '', 'g')) as key, created_at as ts from search_logs"""


@register("cache_replay", _recursive(["search_logs"], CACHE_REQS, S.SEARCH_CACHE_TTL_S,
                                     "r.id, r.user_id, r.key as cache_key, r.ts as requested_at, w.hit, w.anchor_id"))
def q_cache_replay(spark, sf_dir):
    logs = Domain(spark, sf_dir).search_logs()
    reqs = logs.select("id", "user_id",
                       TX.search_cache_key(F.col("user_id"), F.col("query")).alias("cache_key"),
                       F.col("created_at").alias("requested_at"))
    # the requests are a projection of the stored log: re-read, not materialised
    return TTL.replay(reqs, ["cache_key"], "requested_at", S.SEARCH_CACHE_TTL_S,
                      with_anchor=True, materialise=False).select(
        "id", "user_id", "cache_key", "requested_at", "hit", "anchor_id")


REPORT_REQS = """select id, concat_ws(':', 'analytics', type, cast(days as varchar)) as key,
  requested_at as ts from report_requests"""


@register("report_snapshot_replay", _recursive(["report_requests"], REPORT_REQS,
                                               S.REPORT_CACHE_TTL_S,
                                               "r.id, r.key as cache_key, r.ts as requested_at, w.hit, w.anchor_id"))
def q_report_snapshot_replay(spark, sf_dir):
    rr = Domain(spark, sf_dir).report_requests()
    reqs = rr.select("id", TX.analytics_cache_key(F.col("type"), F.col("days")).alias("cache_key"),
                     "requested_at")
    return TTL.replay(reqs, ["cache_key"], "requested_at", S.REPORT_CACHE_TTL_S,
                      with_anchor=True, materialise=False).select(
        "id", "cache_key", "requested_at", "hit", "anchor_id")


PERM_REQS = """select l.id, l.user_id, concat('permissions:', cast(l.user_id as varchar), ':',
    cast(coalesce((select max(p.at) from permission_events p where p.user_id = l.user_id and p.at <= l.created_at),
                  TIMESTAMP '1970-01-01') as varchar)) as key,
  l.created_at as ts from search_logs l"""


@register("permission_cache_replay", _recursive(["search_logs", "permission_events"], PERM_REQS,
                                                S.PERMISSION_CACHE_TTL_S,
                                                "r.id, r.user_id, r.ts as requested_at, w.hit"))
def q_permission_cache_replay(spark, sf_dir):
    """TTL-3: permission lookups of every logged search, with the permission
    change events as invalidations of the user's entry."""
    d = Domain(spark, sf_dir)
    reqs = d.search_logs().select("id", "user_id", F.col("created_at").alias("requested_at"))
    resets = d.permission_events().select("user_id", "at")
    out = TTL.replay_with_resets(reqs, resets, ["user_id"], "requested_at", "at",
                                 S.PERMISSION_CACHE_TTL_S)
    return out.select("id", "user_id", "requested_at", "hit")
