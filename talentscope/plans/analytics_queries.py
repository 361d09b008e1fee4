"""Registered analytics, scan and projection queries (AGG, SRT, WIN, PRJ, FLT, SRC-1/3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.functions.time import DEFAULT_AS_OF
from talentscope.operators import analytics as A
from talentscope.operators import access as ACC
from talentscope.operators.ordinal import ordinal
from talentscope.plans.oracle_bindings import with_bindings, with_ctes
from talentscope.plans.registry import register
from talentscope.sources.bindings import Domain
from talentscope.sources import codec

AS_OF = f"TIMESTAMP '{DEFAULT_AS_OF}'"


def _window(col: str, days: int) -> str:
    return f"{col} > {AS_OF} - INTERVAL {days} DAY"


def _daily_sql(days: int) -> str:
    return f"""
select cast(date_trunc('day', created_at) as timestamp) as day, count(*) as search_count,
  count(distinct user_id) as unique_users, round(avg(tokens_used), 6) as avg_tokens,
  round(avg(latency_ms), 6) as avg_latency,
  round(cast(sum(case when cache_hit then 1 else 0 end) as double) / count(*) * 100, 6) as cache_hit_rate
from search_logs where {_window('created_at', days)}
group by 1 order by 1 desc"""


DAILY_SQL = _daily_sql(S.DEFAULT_DAYS)


def _popular_sql(k: int) -> str:
    return f"""
select query, count(*) as count from search_logs where {_window('created_at', S.POPULAR_WINDOW_DAYS)}
group by query order by count desc, query asc limit {k}"""


def _summary_sql(days: int, daily: str = "daily") -> str:
    return f"""
select cast(coalesce((select sum(search_count) from {daily}), 0) as bigint) as total_searches,
  (select count(distinct user_id) from search_logs where {_window('created_at', days)}) as unique_users,
  (select count(distinct unique_users) from {daily}) as distinct_daily_user_counts,
  round((select avg(a) from (select avg(results_count) as a from search_history
          where {_window('created_at', days)} group by date_trunc('day', created_at))), 6) as avg_results_per_search"""


# (name, kind) of the fields of each part, in the order Spark's to_json writes them
DAILY_FIELDS = [("day", "ts"), ("search_count", "num"), ("unique_users", "num"),
                ("avg_tokens", "num"), ("avg_latency", "num"), ("cache_hit_rate", "num")]
POPULAR_FIELDS = [("query", "str"), ("count", "num")]
SUMMARY_FIELDS = [("total_searches", "num"), ("unique_users", "num"),
                  ("distinct_daily_user_counts", "num"), ("avg_results_per_search", "num")]


def _json_sql(fields) -> str:
    """DuckDB expression writing one row as Spark's ``to_json(struct(...))``
    does: fields in order, NULL fields left out, timestamps as
    ``yyyy-MM-ddTHH:mm:ss.SSS``, numbers in their shortest form."""
    parts = []
    for name, kind in fields:
        if kind == "str":
            v = f"to_json({name})"
        elif kind == "ts":
            v = f"""'"' || strftime({name}, '%Y-%m-%dT%H:%M:%S.%g') || '"'"""
        else:
            v = f"cast({name} as varchar)"
        parts.append(f"""'"{name}":' || {v}""")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


@register("daily_search_metrics", with_bindings(["search_logs"], DAILY_SQL))
def q_daily_search_metrics(spark, sf_dir):
    return A.daily_search_metrics(Domain(spark, sf_dir).search_logs())


@register("popular_searches", with_bindings(["search_logs"], _popular_sql(S.POPULAR_K_OVERVIEW)))
def q_popular_searches(spark, sf_dir):
    return A.popular_searches(Domain(spark, sf_dir).search_logs())


@register("most_viewed", with_bindings(["resumes", "resume_views"], f"""
select r.id, r.name, r.email, count(rv.id) as view_count
from resumes r join resume_views rv on r.id = rv.resume_id
where {_window('rv.viewed_at', 30)}
group by r.id, r.name, r.email order by view_count desc, r.id asc limit 10"""))
def q_most_viewed(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return A.most_viewed(d.resumes(), d.resume_views())


@register("analytics_summary", with_ctes(["search_logs", "search_history"], {"daily": DAILY_SQL},
                                          _summary_sql(S.DEFAULT_DAYS)))
def q_analytics_summary(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return A.analytics_summary(d.search_logs(), d.search_history())


@register("avg_results_by_query", with_bindings(["search_history"], f"""
select cast(date_trunc('day', created_at) as timestamp) as day, query, count(*) as searches,
  round(sum(results_count) / count(*), 6) as avg_results,
  case when sum(results_count) >= 0 then floor((sum(results_count)*20 + count(*)) / (2*count(*)))
       else -floor((-sum(results_count)*20 + count(*)) / (2*count(*))) end / 10 as avg_results_1dp
from search_history where {_window('created_at', 7)} group by 1, 2"""))
def q_avg_results_by_query(spark, sf_dir):
    return A.avg_results_by_query(Domain(spark, sf_dir).search_history())


@register("recent_searches_per_user", with_bindings(["search_logs"], """
select * from (select *, row_number() over (partition by user_id order by created_at desc, id desc) as rank
from search_logs) where rank <= 50"""))
def q_recent_searches_per_user(spark, sf_dir):
    return A.recent_searches_per_user(Domain(spark, sf_dir).search_logs())


def _overview_oracle() -> str:
    ctes, selects = {}, []
    for days in (7, 30):
        ctes[f"daily_{days}"] = _daily_sql(days)
        ctes[f"summary_{days}"] = _summary_sql(days, f"daily_{days}")
    for k in (S.POPULAR_K_OVERVIEW, S.POPULAR_K_SEARCHES):
        ctes[f"popular_{k}"] = _popular_sql(k)
    for rtype, k in (("overview", S.POPULAR_K_OVERVIEW), ("searches", S.POPULAR_K_SEARCHES)):
        for days in (7, 30):
            parts = [("daily", f"daily_{days}", DAILY_FIELDS), ("popular", f"popular_{k}", POPULAR_FIELDS)]
            if rtype != "searches":
                parts.append(("summary", f"summary_{days}", SUMMARY_FIELDS))
            selects += [f"select '{rtype}' as report_type, {days} as days, '{name}' as part, "
                        f"{_json_sql(fields)} as payload from {cte}" for name, cte, fields in parts]
    return with_ctes(["search_logs", "search_history"], ctes, "\nunion all\n".join(selects))


@register("analytics_overview", _overview_oracle())
def q_analytics_overview(spark, sf_dir):
    """AGG-9: both report types for 7 and 30 days, as JSON rows."""
    d = Domain(spark, sf_dir)
    return A.analytics_reports(d.search_logs(), d.search_history())


@register("scan_search_logs", with_bindings(["search_logs"], "select * from search_logs"))
def q_scan_search_logs(spark, sf_dir):
    return Domain(spark, sf_dir).search_logs().select("*")


@register("project_users", with_bindings(["users"], "select id, email, name, role from users"))
def q_project_users(spark, sf_dir):
    return Domain(spark, sf_dir).users().select("id", "email", "name", "role")


@register("drop_sensitive", with_bindings(["users"], "select id, email, name, role from users"))
def q_drop_sensitive(spark, sf_dir):
    return Domain(spark, sf_dir).users().drop("password_hash")


@register("documents_newest_first", with_bindings(["resumes"], """
select id, name, created_at, row_number() over (order by created_at desc, id asc) as position from resumes"""))
def q_documents_newest_first(spark, sf_dir):
    r = Domain(spark, sf_dir).resumes().select("id", "name", "created_at")
    return ordinal(r, [], [F.col("created_at").desc(), F.col("id").asc()], "position")


@register("lookup_by_keys", with_ctes(["resumes", "update_requests"], {}, """
select q.req_id, q.id, r.id is not null as found, r.name, r.email
from (select req_id, case when req_id % 17 = 0 then -id - 1 else id end as id from update_requests) q
left join resumes r on r.id = q.id"""))
def q_lookup_by_keys(spark, sf_dir):
    """FLT-1, with keys that no document has."""
    d = Domain(spark, sf_dir)
    key = F.when(F.col("req_id") % 17 == 0, -F.col("id") - 1).otherwise(F.col("id"))
    return ACC.lookup_by_keys(d.resumes(), d.update_requests().select("req_id", key.alias("id")),
                              ["name", "email"])


@register("own_search_history", with_bindings(["search_history", "users"], """
select h.user_id, h.id, h.query, h.created_at from search_history h
where exists (select 1 from users u where u.id = h.user_id)"""))
def q_own_search_history(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return ACC.own_rows(d.search_history(), d.users()).select("user_id", "id", "query", "created_at")


@register("role_gate", with_bindings(["users"], """
select id, role, case role when 'viewer' then 0 when 'manager' then 1 when 'admin' then 2 end as rank,
  coalesce(case role when 'viewer' then 0 when 'manager' then 1 when 'admin' then 2 end >= 2, false) as can_admin,
  coalesce(case role when 'viewer' then 0 when 'manager' then 1 when 'admin' then 2 end >= 1, false) as can_manage
from users"""))
def q_role_gate(spark, sf_dir):
    u = Domain(spark, sf_dir).users()
    return ACC.role_gate(u, {"can_admin": "admin", "can_manage": "manager"}).select(
        "id", "role", "rank", "can_admin", "can_manage")


@register("decode_event_props", """
select event_id, case when json_valid(props) then try_cast(json_extract(props, '$.k') as bigint) end as k,
  case when json_valid(props) then null else props end as corrupt_record
from (select event_id, case when event_id % 97 = 0 then concat('{', props) when event_id % 89 = 0 then 'k=1'
  else props end as props from events)""")
def q_decode_event_props(spark, sf_dir):
    """SRC-3, with some records that are no JSON."""
    d = Domain(spark, sf_dir)
    i = F.col("event_id")
    events = d.t.events.withColumn("props", F.when(i % 97 == 0, F.concat(F.lit("{"), F.col("props")))
                                   .when(i % 89 == 0, "k=1").otherwise(F.col("props")))
    return codec.decode_json(events, "props", S.EVENT_PROPS, keep=["event_id"]).select(
        "event_id", F.col("decoded.k").alias("k"), "corrupt_record")


@register("export_results_json", with_ctes(["search_logs"], {"daily": _daily_sql(30)},
                                          f"select {_json_sql(DAILY_FIELDS)} as json from daily"))
def q_export_results_json(spark, sf_dir):
    """SRC-4: daily metrics encoded as JSON lines."""
    daily = A.daily_search_metrics(Domain(spark, sf_dir).search_logs(), days=30)
    return codec.encode_json(daily)
