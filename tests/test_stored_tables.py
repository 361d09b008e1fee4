"""Tables changed in place: bucketed merges, generated ids, batch appends, index segments."""

import json
import os
import re
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from talentscope import schemas as S
from talentscope.functions.ids import name_uuid
from talentscope.operators import analytics as A
from talentscope.operators import conversations as CNV
from talentscope.operators import search as SR
from talentscope.operators import validation as VAL
from talentscope.operators.text_index import TextIndex
from talentscope.sources.batches import BatchTable, conformed, constraint_report, rules_of
from talentscope.sources.buckets import BUCKET, BucketedTable


def folder(name):
    return os.path.join(tempfile.mkdtemp(prefix="talentscope-stored-"), name)


def files(path):
    """{part file below the folder: (bytes, time of its last change)}"""
    out = {}
    for base, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                st = os.stat(os.path.join(base, n))
                out[os.path.relpath(os.path.join(base, n), path)] = (st.st_size, st.st_mtime_ns)
    return out


CONVERSATIONS = ("id string, user_id long, title string, context string, created_at timestamp_ntz, "
                 "updated_at timestamp_ntz")


def conversations(spark, n=40, buckets=8):
    rows = spark.range(n).select(
        F.concat(F.lit("c"), F.col("id")).alias("id"), (F.col("id") % 5).alias("user_id"),
        F.concat(F.lit("t"), F.col("id")).alias("title"), F.lit(None).cast("string").alias("context"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    return BucketedTable(spark, folder("conversations"), rows.schema, ["id"], buckets).write(rows)


def updates(spark, rows):
    return spark.createDataFrame(
        [(1, i, *r[:-1], f"2024-01-02 00:00:{r[-1]:02d}") for i, r in enumerate(rows)],
        "kind int, req_id int, id string, user_id long, title string, context string, at string").select(
        "kind", "req_id", "id", "user_id", "title", "context",
        F.col("at").cast("timestamp_ntz").alias("requested_at"))


def test_conversation_merge_rewrites_only_touched_buckets(spark):
    table = conversations(spark)
    before, rows = files(table.path), {r["id"]: r for r in table.read().collect()}
    created = spark.createDataFrame([("n1", 9, "new one", None)], "id string, user_id long, title string, "
                                    "context string").select(
        "*", *[F.lit("2024-01-02").cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")])
    up = updates(spark, [("c3", 3, "late", None, 9), ("c3", 3, "early", '{"a":1}', 2),
                         ("c3", 4, "not the owner", None, 30), ("zz", 1, "no such row", None, 3),
                         ("n1", 9, None, '{"n":1}', 5), ("n1", 1, "other", None, 6)])
    touched = CNV.update_conversations(table, created, up)
    after = files(table.path)
    assert 0 < len(touched) < 8

    def part(name):
        return int(re.match(rf"{BUCKET}=(\d+)", name).group(1))
    kept = {n: v for n, v in before.items() if part(n) not in touched}
    assert kept == {n: v for n, v in after.items() if part(n) not in touched}
    assert not {n for n in before if part(n) in touched} & set(after)
    got = {r["id"]: r for r in table.read().collect()}
    assert (got["c3"]["title"], got["c3"]["context"], str(got["c3"]["updated_at"])) == (
        "late", '{"a":1}', "2024-01-02 00:00:09")
    assert (got["n1"]["title"], got["n1"]["context"], str(got["n1"]["created_at"])) == (
        "new one", '{"n":1}', "2024-01-02 00:00:00")
    assert len(got) == len(rows) + 1
    assert all(got[i] == r for i, r in rows.items() if i != "c3")
    # the same batch once more changes nothing
    CNV.update_conversations(table, created, up)
    assert {r["id"]: r for r in table.read().collect()} == got


def test_merge_reads_only_touched_folders(spark):
    table = conversations(spark)
    plan = table.read([2, 5])._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*{BUCKET}[^\]]* IN \(2,5\)", plan)
    scanned = table.read([2, 5]).select(F.input_file_name()).distinct().collect()
    assert scanned and all(re.search(rf"{BUCKET}=[25]/", r[0]) for r in scanned)


def test_merge_that_empties_a_bucket(spark):
    table = conversations(spark, 6, 3)
    ids = [r["id"] for r in table.read([0]).collect()]
    gone = spark.createDataFrame([(i,) for i in ids], "id string")
    table.merge(gone, lambda current, c: current.join(c, "id", "left_anti"))
    assert table.read([0]).count() == 0 and table.read().count() == 6 - len(ids)
    table.merge(gone, lambda current, c: current.unionByName(c, allowMissingColumns=True))
    assert {r["id"] for r in table.read([0]).collect()} == set(ids)
    assert table.merge(gone.limit(0), lambda current, c: current) == []


def test_titles_that_do_not_fit_are_refused(spark):
    up = updates(spark, [("c1", 1, "t" * 256, None, 1), ("c1", 1, "t" * 255, None, 2), ("c1", 1, None, None, 3)])
    assert [r["req_id"] for r in CNV.valid_conversation_updates(up).collect()] == [1]


def test_history_grows_in_parts(spark):
    """Two batches behind a stored history; a part that is full is not touched."""
    stored = spark.createDataFrame([("a", t, "user", f"s{t}") for t in range(7)] + [("b", 0, "user", "x")],
                                   "id string, turn long, role string, content string")
    parts = CNV.history_parts(stored, 3)
    table = BucketedTable(spark, folder("history"), parts.schema, ["id", "part"], 16).write(parts)
    full = table.touched(spark.createDataFrame([("a", 0), ("a", 1)], "id string, part long"))
    before = files(table.path)
    served = spark.createDataFrame(
        [(f"q{i}", "a" if i % 3 else "new", f"why{i}", i, f"2024-01-0{1 + i}") for i in range(6)],
        "query string, conversation_id string, response string, id int, at string").select(
        "*", F.col("at").cast("timestamp_ntz").alias("created_at"))
    turns = CNV.search_turns(served, stored)
    touched = CNV.append_history(table, turns, 3)
    got = {}
    for r in table.read().orderBy("id", "part").collect():
        history = json.loads(r["history"])
        assert len(history) == r["n_turns"] <= 3
        got.setdefault(r["id"], []).extend(m["content"] for m in history)
    assert got["a"] == [f"s{t}" for t in range(7)] + ["q1", "why1", "q2", "why2", "q4", "why4", "q5", "why5"]
    assert got["new"] == ["q0", "why0", "q3", "why3"] and got["b"] == ["x"]
    for name, state in before.items():
        b = int(re.match(rf"{BUCKET}=(\d+)", name).group(1))
        if b not in touched:
            assert files(table.path)[name] == state
    assert set(full) - set(touched)


def test_generated_ids_are_stable_and_valid(spark):
    rows = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.lit("x")).alias("v"))
    make = lambda df, batch="b1": [r[0] for r in df.select(
        name_uuid("users", batch, F.col("k"), F.col("v"))).collect()]
    ids = make(rows)
    assert sorted(ids) == sorted(make(rows.repartition(7))) and len(set(ids)) == 300
    assert not set(ids) & set(make(rows, "b2"))
    for i in ids:
        assert re.match(S.UUID_PATTERN.replace(r"\\z", "$").replace(r"\z", "$"), i)
        assert uuid.UUID(i).version == 3 and uuid.UUID(i).variant == uuid.RFC_4122


# -- index segments -----------------------------------------------------------

def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, content string")


def look_up(index, spark, *texts):
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    out = {i: set() for i in range(len(texts))}
    for r in index.search(q).collect():
        out[r["query_id"]].add(r["doc_id"])
    return list(out.values())


def test_index_adds_changes_and_deletes(spark):
    index = TextIndex(spark, folder("index"), 8)
    assert index.segments() == [] and look_up(index, spark, "sql") == [set()]
    index.change(added=docs(spark, [(1, "Java and SQL"), (2, "sql sql"), (3, "the python"), (4, None), (5, "")]))
    assert look_up(index, spark, "SQL", "java sql", "python the", "the", "nothing") == [
        {1, 2}, {1}, {3}, set(), set()]
    index.change(added=docs(spark, [(2, "rust"), (6, "java")]), deleted=docs(spark, [(2, ""), (9, "")]))
    index.change(deleted=docs(spark, [(3, ""), (3, "")]))
    index.change(added=docs(spark, [(3, "python anew")]))           # comes back
    want = [{1}, {1, 6}, {3}, {2}, {3}]
    asked = ("sql", "java", "python", "rust", "anew")
    assert look_up(index, spark, *asked) == want
    index.merge()
    assert len(index.segments()) == 1 and look_up(index, spark, *asked) == want
    tf = {(r["token"], r["doc_id"]): r["tf"] for r in index.postings().collect()}
    assert tf[("python", 3)] == 1 and ("sql", 2) not in tf
    index.vacuum()
    assert look_up(index, spark, *asked) == want
    assert len(os.listdir(os.path.join(index.path, "postings"))) == 1
    index.change(deleted=docs(spark, [(1, "")]))
    assert look_up(index, spark, *asked) == [set(), {6}, {3}, {2}, {3}]


def test_index_step_that_failed_may_be_repeated(spark):
    index = TextIndex(spark, folder("index"), 4)
    index.change(added=docs(spark, [(1, "one")]))
    index._write_postings(SR.token_index(docs(spark, [(2, "two")])), index._next())   # no manifest
    assert look_up(index, spark, "one", "two") == [{1}, set()]
    index.change(added=docs(spark, [(2, "two")]))
    assert look_up(index, spark, "one", "two") == [{1}, {2}]


def test_index_search_reads_only_the_terms_buckets(spark):
    index = TextIndex(spark, folder("index"), 16, files=2)
    index.change(added=docs(spark, [(i, f"word{i} common") for i in range(50)]))
    index.change(added=docs(spark, [(50, "word1")]))
    rows = index.postings([3])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*segment#\d+ IN \(1,2\)", plan)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = 3", plan)
    assert "content" not in plan
    read = index._stored("postings", index._postings, [1, 2]).filter("bucket = 3").select(
        F.input_file_name()).distinct().collect()
    assert read and all("/bucket=3/" in r[0] for r in read)
    result = index.search(spark.createDataFrame([(0, "word1")], "query_id int, text string"))
    assert {r["doc_id"] for r in result.collect()} == {1, 50}
    spread = os.listdir(os.path.join(index.path, "postings", "segment=1"))
    assert sum(len([f for f in os.listdir(os.path.join(index.path, "postings", "segment=1", s))
                    if f.endswith(".parquet")]) == 2 for s in spread if s.startswith("bucket=")) >= 1


def test_index_equals_the_scan(spark):
    texts = docs(spark, [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 6))) for i in range(60)])
    queries = spark.createDataFrame([(i, f"w{i} w{(3 * i) % 13}") for i in range(13)], "query_id int, text string")
    index = TextIndex(spark, folder("index"), 8)
    index.change(added=texts.filter("id < 40"))
    index.change(added=texts.filter("id >= 30"), deleted=texts.filter("id >= 30"))
    assert sorted(map(tuple, index.search(queries).collect())) == sorted(
        map(tuple, SR.text_match_all(texts, queries).collect()))


# -- appends in batches -------------------------------------------------------

def test_repeated_appends_add_nothing(spark):
    table = BatchTable(spark, folder("resumes"), "resumes")
    rows = spark.createDataFrame([(1, "A", "a@x.io", "text", "u1"), (2, "B", None, None, "u1")],
                                 "n int, name string, email string, content string, created_by string")
    assert table.read().count() == 0 and table.ledger().count() == 0
    assert table.append(rows, "b1", ["n"])
    first, state = sorted(map(tuple, table.read().collect())), files(table.path)
    assert not table.append(rows, "b1", ["n"])
    assert sorted(map(tuple, table.read().collect())) == first and files(table.path) == state
    assert table.append(rows, "b2", ["n"])
    got = table.read().collect()
    assert len(got) == 4 and len({r["id"] for r in got}) == 4
    assert {(str(r["created_at"]), str(r["updated_at"]), r["phone"]) for r in got} == {
        ("2024-01-31 00:00:00", "2024-01-31 00:00:00", None)}
    broken = {(r["column_name"], r["rule"]): r["violations"] for r in constraint_report([table]).collect()}
    assert broken[("content", "not_null")] == 2 and broken[("name", "not_null")] == 0


def test_append_that_failed_half_way_is_invisible_and_repeatable(spark):
    table = BatchTable(spark, folder("users"), "users")
    rows = spark.createDataFrame([("a@x.io", "h", "A"), ("b@x.io", "h", "B")], "email string, password_hash string, name string")
    whole = conformed(rows, "users", "b1", ["email"])
    whole.limit(1).write.parquet(f"{table.path}/rows/batch=b1")        # died before its ledger row
    assert table.read().count() == 0
    assert table.append(rows, "b1", ["email"])
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, whole.collect()))
    assert {r["role"] for r in table.read().collect()} == {"viewer"}
    with pytest.raises(ValueError):
        table.append(rows, "a/b", ["email"])


def test_append_counts_take_no_second_scan(spark):
    """The rows pass the plan once: a counter inside the scan sees each row one time."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.range(500, numPartitions=4).selectExpr("cast(id as string) as user_id", "if(id % 5 = 0, null, 'q') as query")
    rows = rows.mapInArrow(count, rows.schema)
    table = BatchTable(spark, folder("logs"), "search_logs")
    table.append(rows, "b", ["user_id"])
    assert seen.value == 500
    assert constraint_report([table]).filter("column_name = 'query'").first()["violations"] == 100


def test_every_rule_is_broken_by_some_row(spark):
    import __spark_entry__ as E
    rows = E.queries()["constraint_report"](spark, SF_SMALL).collect()
    assert len(rows) == sum(len(rules_of(t)) for t in S.STORED_TABLES)
    # a NULL role takes the column's default
    assert {(r["table_name"], r["column_name"], r["rule"]) for r in rows if not r["violations"]} == {
        ("users", "role", "not_null")}


def test_usage_facts_scan_the_log_once_and_count_users_exactly(spark):
    import datetime as dt
    import random
    r = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, r.choice([None, 0, -3, 1, 32768, 32769, 32770, 10 ** 12, r.randint(0, 60)]),
             start + dt.timedelta(minutes=r.randint(0, 43200)), r.choice(["a", "b", None]),
             r.choice([None, r.randint(0, 9)]), r.choice([None, 5]), r.choice([True, False, None]))
            for i in range(3000)]
    logs = spark.createDataFrame(rows, "id long, user_id long, created_at timestamp_ntz, query string, "
                                       "tokens_used int, latency_ms int, cache_hit boolean")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    history = logs.select("created_at", F.col("tokens_used").alias("results_count"))
    as_of = "2024-01-24 13:37:00"
    out = A.analytics_reports(logs.mapInArrow(count, logs.schema), history, as_of=as_of).collect()
    assert seen.value == len(rows)
    got = {(x["report_type"], x["days"], x["part"], x["payload"]) for x in out}
    want = set()
    for kind in ("overview", "searches"):
        for days in (7, 30):
            for x in A.report_rows(A.analytics_report(logs, history, kind, days, as_of), kind, days).collect():
                want.add(tuple(x))
    assert got == want


def test_foreign_keys_shuffle_distinct_keys_only(spark):
    """A hot key is one row a task, and the child's rows are not shuffled."""
    parents = spark.createDataFrame([("p0",), ("p1",)], "id string")
    child = spark.range(20000, numPartitions=4).selectExpr(
        "id", "case when id % 3 < 2 then 'p0' when id = 5 then 'gone' when id = 8 then null else 'p1' end as created_by")
    out = VAL.fk_violations({"users": parents, "resumes": child.repartition(4)})
    assert [tuple(r) for r in out.collect()] == [("resumes", "created_by", "users", "5", "gone")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final and "LeftAnti" in final and "LeftSemi" in final


def test_foreign_keys_meet_in_all_shuffle_partitions(spark):
    """The parent's keys are not aggregated, and AQE does not join the tasks that meet."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get(
        "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        parents = spark.range(3000).selectExpr("concat('p', id % 1500) as id")      # every key twice
        child = spark.range(4000).selectExpr("id", "concat('p', id % 1600) as created_by")
        out = VAL.fk_violations({"users": parents, "resumes": child})
        assert sorted(r["missing_key"] for r in out.collect()) == sorted(
            f"p{i % 1600}" for i in range(4000) if i % 1600 >= 1500)
        meet = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("LeftAnti")[1]
        assert "REPARTITION_BY_NUM" in meet and "coalesced" not in meet
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[0])
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", kept[1])
