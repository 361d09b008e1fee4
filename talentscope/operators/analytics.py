"""Usage analytics: AGG-1..9, SRT-1/2, WIN-2.

All aggregates are global (over every user), as the analytics client is not
user-scoped. Each one is a filter → partial aggregate → exchange → final
aggregate plan, so a hot key is combined map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.functions.time import DEFAULT_AS_OF, day_of, within_days
from talentscope.session import cut_lineage

FLOAT_DIGITS = 6


def daily_search_metrics(logs: DataFrame, as_of: str = DEFAULT_AS_OF,
                         days: int = S.DEFAULT_DAYS) -> DataFrame:
    """AGG-1: per day of the window: searches, distinct users, mean tokens and
    latency (NULLs skipped), cache-hit percentage. Newest day first; days
    without rows are absent."""
    n = F.count(F.lit(1))
    return (logs.filter(within_days(F.col("created_at"), as_of, days))
            .groupBy(day_of(F.col("created_at")).alias("day"))
            .agg(n.alias("search_count"),
                 F.count_distinct("user_id").alias("unique_users"),
                 F.round(F.avg("tokens_used"), FLOAT_DIGITS).alias("avg_tokens"),
                 F.round(F.avg("latency_ms"), FLOAT_DIGITS).alias("avg_latency"),
                 F.round(F.count_if(F.col("cache_hit")).cast("double") / n * 100,
                         FLOAT_DIGITS).alias("cache_hit_rate"))
            .orderBy(F.col("day").desc()))


def popular_searches(logs: DataFrame, as_of: str = DEFAULT_AS_OF,
                     k: int = S.POPULAR_K_OVERVIEW,
                     days: int = S.POPULAR_WINDOW_DAYS) -> DataFrame:
    """AGG-2 + SRT-2: exact query text counted over the window, top k, ties
    broken by the text. Planned as TakeOrderedAndProject (no global sort)."""
    return (logs.filter(within_days(F.col("created_at"), as_of, days))
            .groupBy("query").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("query").asc())
            .limit(k))


def view_counts(views: DataFrame, as_of: str = DEFAULT_AS_OF,
                days: int = S.VIEWED_WINDOW_DAYS) -> DataFrame:
    """Views per document over the window, aggregated before any join."""
    return (views.filter(within_days(F.col("viewed_at"), as_of, days))
            .groupBy("resume_id").agg(F.count("id").alias("view_count")))


def most_viewed(resumes: DataFrame, views: DataFrame, as_of: str = DEFAULT_AS_OF,
                k: int = S.MOST_VIEWED_K, days: int = S.VIEWED_WINDOW_DAYS) -> DataFrame:
    """AGG-3 + JON-1: top-k documents by views in the window.

    Views are pre-aggregated per document (at most one row per document),
    kept only for documents that exist (semi-join on the id column alone),
    cut to the k winners, and only those k rows — a bounded side — are joined
    back for name and email (and ordered again: a join keeps no order).
    """
    counts = view_counts(views, as_of, days)
    ids = resumes.select(F.col("id").alias("resume_id"))
    top = (counts.join(ids, "resume_id", "left_semi")
           .orderBy(F.col("view_count").desc(), F.col("resume_id").asc())
           .limit(k))
    docs = resumes.select(F.col("id").alias("resume_id"), "name", "email")
    return (F.broadcast(top).join(docs, "resume_id", "inner")
            .select(F.col("resume_id").alias("id"), "name", "email", "view_count")
            .orderBy(F.col("view_count").desc(), F.col("id").asc()))


def analytics_summary(logs: DataFrame, history: DataFrame, as_of: str = DEFAULT_AS_OF,
                      days: int = S.DEFAULT_DAYS, daily: DataFrame | None = None) -> DataFrame:
    """AGG-6: one row over the day window (``daily``: its daily metrics, if they are
    at hand).

    ``total_searches`` = Σ daily counts; ``unique_users`` = true distinct users;
    ``distinct_daily_user_counts`` = the number of distinct daily user counts
    (what the summary computes as written); ``avg_results_per_search`` = the
    unweighted mean of daily mean result counts (NULL on an empty window).
    """
    spark = logs.sparkSession
    daily = daily_search_metrics(logs, as_of, days) if daily is None else daily
    window = logs.filter(within_days(F.col("created_at"), as_of, days))
    hist_daily = (history.filter(within_days(F.col("created_at"), as_of, days))
                  .groupBy(day_of(F.col("created_at")).alias("day"))
                  .agg(F.avg("results_count").alias("avg_results")))
    return spark.range(1).select(
        F.coalesce(daily.agg(F.sum("search_count")).scalar(), F.lit(0)).cast("long")
         .alias("total_searches"),
        window.agg(F.count_distinct("user_id")).scalar().alias("unique_users"),
        daily.agg(F.count_distinct("unique_users")).scalar().alias("distinct_daily_user_counts"),
        F.round(hist_daily.agg(F.avg("avg_results")).scalar(), FLOAT_DIGITS)
         .alias("avg_results_per_search"),
    )


def avg_results_by_query(history: DataFrame, as_of: str = DEFAULT_AS_OF,
                         days: int = S.DEFAULT_DAYS) -> DataFrame:
    """AGG-7: mean results per search per day and query; ``avg_results_1dp``
    is the one-decimal display value, rounded half away from zero on the
    exact ratio (integer arithmetic, so no binary-float ties)."""
    g = (history.filter(within_days(F.col("created_at"), as_of, days))
         .groupBy(day_of(F.col("created_at")).alias("day"), "query")
         .agg(F.count(F.lit(1)).alias("searches"),
              F.sum("results_count").cast("long").alias("total_results")))
    s, n = F.col("total_results"), F.col("searches")
    tenths = F.when(s >= 0, F.floor((s * 20 + n) / (n * 2))).otherwise(-F.floor((-s * 20 + n) / (n * 2)))
    return g.select("day", "query", "searches",
                    F.round(s / n, FLOAT_DIGITS).alias("avg_results"),
                    (tenths / 10).alias("avg_results_1dp"))


def recent_searches_per_user(logs: DataFrame, k: int = S.HISTORY_K) -> DataFrame:
    """WIN-2: the latest k log rows of every user (newest first, id breaks ties).

    ``rank <= k`` over a per-user window is planned with a partial
    WindowGroupLimit before the exchange, so at most k rows per user leave any
    map task, however many rows one user has."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (logs.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("long")))


def analytics_report(logs: DataFrame, history: DataFrame, report_type: str = "overview",
                     days: int = S.DEFAULT_DAYS, as_of: str = DEFAULT_AS_OF) -> dict:
    """AGG-9: the report bundle by type, as named DataFrames.

    ``searches`` → daily + top 20; anything else → daily + top 10 + summary.
    The parts are independent plans over the same logs.
    """
    parts = {"daily": daily_search_metrics(logs, as_of, days)}
    if report_type == "searches":
        parts["popular"] = popular_searches(logs, as_of, S.POPULAR_K_SEARCHES)
    else:
        parts["popular"] = popular_searches(logs, as_of, S.POPULAR_K_OVERVIEW)
        parts["summary"] = analytics_summary(logs, history, as_of, days)
    return parts


def usage_facts(logs: DataFrame, windows, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """The log folded to one row per (day, window, user, query): ``window`` is the
    shortest of the trailing ``windows`` that holds the row (a day that a window's edge
    cuts has rows in two), the rest are sums. One scan; partial sums leave it."""
    windows = sorted(windows)
    shortest = F.coalesce(*[F.when(within_days(F.col("created_at"), as_of, d), d) for d in windows])
    return (logs.filter(within_days(F.col("created_at"), as_of, windows[-1]))
            .groupBy(day_of(F.col("created_at")).alias("day"), shortest.alias("window"),
                     "user_id", "query")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum("tokens_used").alias("tokens"), F.count("tokens_used").alias("n_tokens"),
                 F.sum("latency_ms").alias("latency"), F.count("latency_ms").alias("n_latency"),
                 F.count_if(F.col("cache_hit")).alias("hits")))


def user_bitmaps(facts: DataFrame) -> DataFrame:
    """(day, window, block, users): the users of each day and window as bitmaps, one of
    4 KB per block of 32,768 user ids (which are integers). Bitmaps of days can be
    joined by OR into those of any period, so distinct users stay exact; a new day
    adds its rows and changes none."""
    return (facts.filter(F.col("user_id").isNotNull())
            .groupBy("day", "window", F.bitmap_bucket_number("user_id").alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users")))


def distinct_users(bitmaps: DataFrame, *by: str) -> DataFrame:
    """Exact distinct users per ``by``, from bitmaps."""
    return (bitmaps.groupBy(*by, "block").agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n"))
            .groupBy(*by).agg(F.sum("n").alias("unique_users")))


def daily_from_facts(facts: DataFrame, bitmaps: DataFrame, days: int) -> DataFrame:
    """AGG-1 over one of the windows of ``facts``."""
    n = F.sum("n")
    sums = (facts.filter(F.col("window") <= days).groupBy("day")
            .agg(n.alias("search_count"),
                 F.round(F.try_divide(F.sum("tokens"), F.sum("n_tokens")), FLOAT_DIGITS).alias("avg_tokens"),
                 F.round(F.try_divide(F.sum("latency"), F.sum("n_latency")), FLOAT_DIGITS)
                 .alias("avg_latency"),
                 F.round(F.sum("hits").cast("double") / n * 100, FLOAT_DIGITS).alias("cache_hit_rate")))
    users = distinct_users(bitmaps.filter(F.col("window") <= days), "day")
    return (sums.join(users, "day", "left")
            .select("day", "search_count", F.coalesce("unique_users", F.lit(0)).alias("unique_users"),
                    "avg_tokens", "avg_latency", "cache_hit_rate")
            .orderBy(F.col("day").desc()))


def popular_from_facts(facts: DataFrame, days: int, k: int) -> DataFrame:
    """AGG-2 over one of the windows of ``facts``."""
    return (facts.filter(F.col("window") <= days).groupBy("query").agg(F.sum("n").alias("count"))
            .orderBy(F.col("count").desc(), F.col("query").asc()).limit(k))


def history_facts(history: DataFrame, windows, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """(day, window, results, n) of the search history: one scan for all windows."""
    windows = sorted(windows)
    shortest = F.coalesce(*[F.when(within_days(F.col("created_at"), as_of, d), d) for d in windows])
    return (history.filter(within_days(F.col("created_at"), as_of, windows[-1]))
            .groupBy(day_of(F.col("created_at")).alias("day"), shortest.alias("window"))
            .agg(F.sum("results_count").alias("results"), F.count("results_count").alias("n")))


def summary_from_facts(daily: DataFrame, bitmaps: DataFrame, history: DataFrame, days: int) -> DataFrame:
    """AGG-6 over one of the windows, from the parts above."""
    per_day = (history.filter(F.col("window") <= days).groupBy("day")
               .agg(F.try_divide(F.sum("results"), F.sum("n")).alias("a")))
    users = distinct_users(bitmaps.filter(F.col("window") <= days)
                           .withColumn("all", F.lit(0)), "all").select("unique_users")
    return daily.sparkSession.range(1).select(
        F.coalesce(daily.agg(F.sum("search_count")).scalar(), F.lit(0)).cast("long")
         .alias("total_searches"),
        F.coalesce(users.scalar(), F.lit(0)).alias("unique_users"),
        daily.agg(F.count_distinct("unique_users")).scalar().alias("distinct_daily_user_counts"),
        F.round(per_day.agg(F.avg("a")).scalar(), FLOAT_DIGITS).alias("avg_results_per_search"))


def analytics_reports(logs: DataFrame, history: DataFrame, types=("overview", "searches"),
                      windows=(7, 30), as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """AGG-9 for several types and windows, as JSON rows, from one scan of the log and
    one of the history: both are folded to facts, and daily metrics, popular queries and
    distinct users of every window come from those."""
    facts = cut_lineage(usage_facts(logs, {*windows, S.POPULAR_WINDOW_DAYS}, as_of))
    bitmaps = cut_lineage(user_bitmaps(facts))
    past = cut_lineage(history_facts(history, windows, as_of))
    daily = {d: cut_lineage(daily_from_facts(facts, bitmaps, d)) for d in windows}
    popular = cut_lineage(popular_from_facts(facts, S.POPULAR_WINDOW_DAYS, S.POPULAR_K_SEARCHES))
    first = popular.orderBy(F.col("count").desc(), F.col("query").asc()).limit(S.POPULAR_K_OVERVIEW)
    out = None
    for kind in types:
        for d in windows:
            parts = {"daily": daily[d], "popular": popular if kind == "searches" else first}
            if kind != "searches":
                parts["summary"] = summary_from_facts(daily[d], bitmaps, past, d)
            rows = report_rows(parts, kind, d)
            out = rows if out is None else out.unionByName(rows)
    return out


def report_rows(parts: dict, report_type: str, days: int) -> DataFrame:
    """SRC-4 form of a report: one JSON row per part row, tagged by part."""
    frames = [df.select(F.lit(report_type).alias("report_type"), F.lit(days).alias("days"),
                        F.lit(name).alias("part"),
                        F.to_json(F.struct(*df.columns)).alias("payload"))
              for name, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
