"""Analytics properties and edge frames, and the relational division against
brute force (SURVEY §5: Σ daily counts, empty window, top-k ties)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import SF_MID
from talentscope.functions.time import DEFAULT_AS_OF
from talentscope.operators import analytics as A
from talentscope.operators import search as SR
from talentscope.sources.bindings import Domain

LOG_SCHEMA = ("id long, user_id long, query string, tokens_used int, latency_ms int, "
              "cache_hit boolean, created_at timestamp_ntz")


def test_daily_counts_sum_to_the_rows_in_the_window(spark):
    logs = Domain(spark, SF_MID).search_logs()
    for days in (1, 7, 30):
        daily = A.daily_search_metrics(logs, days=days)
        total = daily.agg(F.sum("search_count")).first()[0] or 0
        as_of = dt.datetime.fromisoformat(DEFAULT_AS_OF)
        rows = logs.filter(F.col("created_at") > F.lit(as_of - dt.timedelta(days=days))).count()
        assert total == rows
        assert daily.count() <= days + 1


def test_empty_window_gives_no_days_and_a_null_mean(spark):
    old = dt.datetime(2000, 1, 1)
    logs = spark.createDataFrame([(1, 1, "q", 5, 10, False, old)], LOG_SCHEMA)
    hist = spark.createDataFrame([(1, 1, "q", 3, "natural_language", old)],
                                 "id long, user_id long, query string, results_count int, "
                                 "search_type string, created_at timestamp_ntz")
    assert A.daily_search_metrics(logs).count() == 0
    s = A.analytics_summary(logs, hist).first()
    assert s["total_searches"] == 0 and s["unique_users"] == 0
    assert s["avg_results_per_search"] is None


def test_top_k_ties_are_broken_by_the_query_text(spark):
    t = dt.datetime.fromisoformat(DEFAULT_AS_OF) - dt.timedelta(hours=1)
    queries = ["b", "a", "c", "a", "b", "c", "d"]          # a, b, c twice; d once
    logs = spark.createDataFrame([(i, 1, q, 1, 1, False, t) for i, q in enumerate(queries)],
                                 LOG_SCHEMA)
    top = [(r["query"], r["count"]) for r in A.popular_searches(logs, k=2).collect()]
    assert top == [("a", 2), ("b", 2)]


def test_division_equals_brute_force_with_a_hot_term(spark):
    """Every item holds the hot term; queries mix it with rare terms, repeat
    terms, or name a term no item holds."""
    rnd = random.Random(21)
    items = {i: {"hot"} | {f"t{rnd.randrange(12)}" for _ in range(rnd.randrange(0, 5))}
             for i in range(80)}
    queries = {q: {"hot"} | {f"t{rnd.randrange(12)}" for _ in range(rnd.randrange(0, 3))}
               for q in range(30)}
    queries[30] = {"hot"}
    queries[31] = {"hot", "absent"}
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts],
                                  "query_id long, token string")
    post = spark.createDataFrame([(t, i) for i, ts in items.items() for t in ts],
                                 "token string, doc_id long")
    got = {(r["query_id"], r["doc_id"]) for r in SR.match_all_terms(terms, post, "doc_id").collect()}
    want = {(q, i) for q, qt in queries.items() for i, it in items.items() if qt <= it}
    assert got == want
    assert {i for q, i in got if q == 30} == set(items)
    assert not any(q == 31 for q, _ in got)


def test_index_lookup_equals_direct_match_and_reads_only_needed_buckets(spark, tmp_path):
    from talentscope.operators import search as SR
    from talentscope.operators.text_index import TextIndex
    docs = spark.createDataFrame(
        [(1, "Red fish, blue fish"), (2, "one red fish"), (3, "the blue"), (4, None), (5, "")],
        "id long, content string")
    queries = spark.createDataFrame([(1, "red fish"), (2, "blue"), (3, "absent"), (4, "the")],
                                    "query_id long, text string")
    index = SR.token_index(docs)
    assert {tuple(r) for r in index.collect()} == {
        ("red", 1, 1), ("fish", 1, 2), ("blue", 1, 1), ("one", 2, 1), ("red", 2, 1), ("fish", 2, 1),
        ("blue", 3, 1)}
    path = str(tmp_path / "index")
    stored = TextIndex(spark, path, 8, files=2)
    stored.change(added=docs)
    got = {tuple(r) for r in stored.search(queries).collect()}
    assert got == {tuple(r) for r in SR.text_match_all(docs, queries).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 3)}


def test_criteria_of_every_kind_and_an_outlier_salary(spark):
    import json

    from talentscope.operators import search as SR
    docs = [{"skills": ["Java"], "location": "Rome", "experience": [{"position": "Dev"}],
             "salary_expectation": 50.0},
            {"skills": ["sql"], "location": "rome ", "experience": [{"position": "dev", "description": "Big data"}],
             "salary_expectation": 1e15},
            {"skills": ["java", "sql"], "location": "Oslo", "experience": []}]
    resumes = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)],
                                    "id long, parsed_data string")
    asks = [{}, {"skills": ["JAVA"]}, {"location": "Rome"}, {"role": "dev"}, {"salary": {"min": 40}},
            {"salary": {"max": 60}}, {"experience": "big"}, {"salary": {"min": 60, "max": 70}},
            {"skills": ["java", "sql"]}]
    criteria = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(asks)],
                                     "id long, criteria string")
    got = sorted(tuple(r) for r in SR.criteria_match(criteria, resumes).collect())
    want = {0: [0, 1, 2], 1: [0, 2], 2: [0, 1], 3: [0, 1], 4: [0, 1], 5: [0], 6: [1], 7: [], 8: [2]}
    assert got == sorted((c, d) for c, ds in want.items() for d in ds)


def test_most_viewed_is_ordered(spark):
    from conftest import SF_SMALL
    import __spark_entry__ as E
    rows = E.queries()["most_viewed"](spark, SF_SMALL).collect()
    assert rows == sorted(rows, key=lambda r: (-r["view_count"], r["id"]))
