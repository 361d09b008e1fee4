"""Hand-made frames and properties for access policies and mutations."""

import datetime as dt

from pyspark.sql import functions as F

from talentscope.operators import access as ACC
from talentscope.operators import mutations as MUT
from talentscope.operators import validation as VAL

T0 = dt.datetime(2024, 1, 1)


def docs(spark):
    return spark.createDataFrame(
        [(1, "A", "a@x.io", None, 10, T0), (2, "B", "b@x.io", None, 10, T0),
         (3, "C", "c@x.io", None, 20, T0)],
        "id long, name string, email string, phone string, created_by long, created_at timestamp_ntz")


def perms(spark, rows):
    return spark.createDataFrame(rows, "id long, resume_id long, user_id long, can_view boolean, "
                                       "can_edit boolean, granted_by long")


def pairs(df):
    return {(r["user_id"], r["resume_id"]) for r in df.collect()}


def test_visible_editable_policies(spark):
    p = perms(spark, [
        (1, 1, 20, True, False, 10),    # shared for viewing
        (2, 2, 20, False, True, 10),    # edit right without view right: neither
        (3, 3, 20, True, True, 20),     # owner shares with themself
        (4, 1, 30, True, True, 10),     # view + edit
        (5, 1, 30, None, None, 10),     # duplicate row with NULL flags
        (6, 9, 30, True, True, 10),     # document that does not exist
    ])
    d = docs(spark)
    vis = pairs(ACC.visible_documents(d, p))
    edit = pairs(ACC.editable_documents(d, p))
    assert vis == {(10, 1), (10, 2), (20, 3), (20, 1), (30, 1)}
    assert edit == {(10, 1), (10, 2), (20, 3), (30, 1)}
    assert edit <= vis
    assert ACC.visible_documents(d, p).count() == len(vis)  # no duplicates


def test_insert_if_absent_is_idempotent(spark):
    users = spark.createDataFrame([(1, "a@x.io")], "id long, email string")
    batch = spark.createDataFrame([(5, "b@x.io"), (6, "a@x.io"), (7, "b@x.io")], "id long, email string")
    first = {r["id"]: r["status"] for r in MUT.insert_if_absent(users, batch).collect()}
    assert first == {5: "inserted", 6: "exists", 7: "duplicate"}
    after = users.unionByName(MUT.insert_if_absent(users, batch)
                              .filter(F.col("status") == "inserted").select("id", "email"))
    again = MUT.insert_if_absent(after, batch)
    assert again.filter(F.col("status") == "inserted").count() == 0


def test_partial_updates_last_supplier_wins_and_empty_update_is_identity(spark):
    d = docs(spark).select("id", "name", "email", "phone", "created_at")
    editable = spark.createDataFrame([(10, 1), (10, 2)], "user_id long, resume_id long")
    upd = spark.createDataFrame([
        (1, 1, 10, "N1", None, None, T0 + dt.timedelta(1)),
        (2, 1, 10, None, "n@x.io", None, T0 + dt.timedelta(2)),
        (3, 1, 10, "N2", None, None, T0 + dt.timedelta(3)),
        (4, 2, 99, "nope", None, None, T0 + dt.timedelta(1)),    # not allowed to edit
        (5, 2, 10, None, None, None, T0 + dt.timedelta(4)),      # supplies nothing
    ], "req_id long, id long, user_id long, name string, email string, phone string, "
       "requested_at timestamp_ntz")
    out = {r["id"]: r for r in MUT.apply_updates(d, upd, editable, ["name", "email", "phone"],
                                                 valid_col=None).collect()}
    assert (out[1]["name"], out[1]["email"], out[1]["applied_updates"]) == ("N2", "n@x.io", 3)
    assert out[1]["updated_at"] == T0 + dt.timedelta(3)
    assert (out[2]["name"], out[2]["email"]) == ("B", "b@x.io")
    assert out[3]["applied_updates"] == 0 and out[3]["updated_at"] == T0


def test_delete_status_order(spark):
    d = docs(spark)
    views = spark.createDataFrame([(1, 2, 10, None, T0)],
                                  "id long, resume_id long, user_id long, search_log_id long, "
                                  "viewed_at timestamp_ntz")
    req = spark.createDataFrame([(9, 10), (3, 10), (2, 10), (1, 10)], "id long, user_id long")
    st = {r["id"]: r["status"] for r in MUT.delete_status(d, views, req).collect()}
    assert st == {9: "missing", 3: "not_owner", 2: "blocked", 1: "deleted"}
    docs2, perms2 = MUT.apply_deletes(d, perms(spark, [(1, 1, 20, True, False, 10)]),
                                      MUT.delete_status(d, views, req))
    assert {r["id"] for r in docs2.collect()} == {2, 3}
    assert perms2.count() == 0  # cascade


def test_request_rules_report_every_issue(spark):
    req = spark.createDataFrame([(1, "", "bad"), (2, "x" * 501, None), (3, "ok", None)],
                                "id long, query string, conversation_id string")
    out = {r["id"]: r for r in VAL.validate_search_requests(req).collect()}
    assert len(out[1]["errors"]) == 2 and not out[1]["valid"]
    assert len(out[2]["errors"]) == 1
    assert out[3]["valid"]


def test_request_rules_as_the_validator_has_them(spark):
    uuid = "3f2504e0-4f89-41d3-9a0c-0305e82c3301"
    rows = [(1, "x", uuid), (2, "\U0001F600" * 251, None), (3, "\U0001F600" * 250, None),
            (4, "x", uuid + "\n"), (5, "x", "nope")]
    df = spark.createDataFrame(rows, "id long, query string, conversation_id string")
    got = {r["id"]: r["valid"] for r in VAL.validate_search_requests(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False}
    mails = {"a@b.co": True, "o'x+1@a-b.example.org": True, "a@b.c": False, "a..b@x.com": False,
             ".a@x.com": False, "<script>@x.com": False, "a.@x.com": False, "a@x.com\n": False}
    df = spark.createDataFrame(list(mails.items()), "email string, ok boolean")
    assert all(r["v"] == r["ok"] for r in df.select("ok", VAL.email_ok(F.col("email")).alias("v")).collect())


def test_shared_document_join_can_be_split(spark):
    """No aggregate depends on the join's partitioning, so a skewed document splits."""
    d = docs(spark)
    p = spark.range(4000).selectExpr("id", "if(id % 10 < 9, 1L, 2L) as resume_id", "id as user_id",
                                     "true as can_view", "false as can_edit", "10L as granted_by")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        pairs_df = ACC.permission_pairs(d, p)
        assert pairs_df.count() == 4000
        plan = pairs_df._jdf.queryExecution().executedPlan()
        pairs_df.collect()
        assert "skew=true" in plan.toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_permission_index_of_uuids_in_bounded_blocks(spark):
    import uuid
    ids = sorted(str(uuid.UUID(int=i * 7919 << 90 | i)) for i in range(1, 40))
    d = spark.createDataFrame([(i,) for i in reversed(ids)], "id string").repartition(4)
    vis = spark.createDataFrame([(u, i) for u in (1, 2) for i in ids if u == 1 or hash(i) % 3], "user_id int, resume_id string")
    out = ACC.permission_index(vis, ACC.id_dictionary(d), block=4).collect()
    assert max(r["n_ids"] for r in out) <= 4
    for u in (1, 2):
        mine = [i for r in sorted((r for r in out if r["user_id"] == u), key=lambda r: r["block"])
                for i in r["ids"].split(",")]
        assert mine == sorted(r["resume_id"] for r in vis.filter(f"user_id = {u}").collect())
    blocks = {i: r["block"] for r in out for i in r["ids"].split(",")}
    assert blocks == {i: n // 4 for n, i in enumerate(ids)}
