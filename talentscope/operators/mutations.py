"""Row mutations as bulk set operations: JON-5, MUT-1..3 (appends: ``sources.batches``).

Plain parquet has no MERGE, so a mutation produces the next version of a
table (and a status per request) from the current version and a batch of
requests: anti-joins for inserts-if-absent and deletes, a keyed aggregate
plus a left join for partial updates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentscope import schemas as S


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str = "email",
                     order: str = "id") -> DataFrame:
    """JON-5: status of each incoming row: ``inserted`` when its key is new,
    ``exists`` when the table has it, ``duplicate`` when an earlier row of the
    same batch (by ``order``) already carries it. Applying the batch twice
    inserts nothing the second time.

    The first row per key is found with a ``min`` aggregate (partial
    aggregation, safe for a hot key) and a join back on (key, order).
    """
    firsts = incoming.groupBy(key).agg(F.min(order).alias("_first"))
    present = existing.select(F.col(key).alias("_present")).distinct()
    return (incoming.join(firsts, key, "left")
            .join(present, F.col(key) == F.col("_present"), "left")
            .withColumn("status",
                        F.when(F.col("_present").isNotNull(), F.lit("exists"))
                         .when(F.col(order) != F.col("_first"), F.lit("duplicate"))
                         .otherwise(F.lit("inserted")))
            .drop("_first", "_present"))


def register_users(users: DataFrame, registrations: DataFrame, validated: DataFrame) -> DataFrame:
    """MUT-3: registration = validation, insert-if-absent on email, default role.

    ``validated`` is ``registrations`` with a ``valid`` flag (VAL-4). Invalid
    rows never reach the key check."""
    ok = validated.filter(F.col("valid")).select(*registrations.columns)
    bad = validated.filter(~F.col("valid")).select(*registrations.columns) \
        .withColumn("status", F.lit("invalid"))
    decided = insert_if_absent(users, ok, "email", "id")
    decided = decided.withColumn("role", F.coalesce(F.col("role"), F.lit(S.DEFAULT_ROLE)))
    return decided.unionByName(bad)


def apply_updates(base: DataFrame, updates: DataFrame, editable: DataFrame,
                  fields: list[str], valid_col: str | None = "valid") -> DataFrame:
    """MUT-1: the next version of ``base`` after a batch of partial updates.

    An update counts if it is valid and its user may edit the row. Applied in
    time order, each update sets only the fields it supplies, so a field ends
    with the value of the last update that supplied it: ``max_by`` over
    (requested_at, req_id), with NULL ordering for updates that did not
    supply the field. ``updated_at`` is the time of the last applied update.
    """
    ok = updates
    if valid_col:
        ok = ok.filter(F.col(valid_col))
    ok = ok.join(editable.select(F.col("user_id"), F.col("resume_id").alias("id")),
                 ["user_id", "id"], "left_semi")
    when = F.struct("requested_at", "req_id")
    latest = ok.groupBy("id").agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), when)).alias(f"_new_{f}") for f in fields],
        F.max("requested_at").alias("_updated_at"),
        F.count(F.lit(1)).alias("applied_updates"))
    out = base.join(latest, "id", "left")
    cols = []
    for c in base.columns:
        cols.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c))
    created = F.col("created_at") if "created_at" in base.columns else F.lit(None)
    return out.select(*cols,
                      F.coalesce(F.col("_updated_at"), created).alias("updated_at"),
                      F.coalesce(F.col("applied_updates"), F.lit(0)).alias("applied_updates"))


def delete_status(resumes: DataFrame, views: DataFrame, requests: DataFrame) -> DataFrame:
    """MUT-2: status of each delete request, checks in order: ``missing`` (no
    such row), ``not_owner``, ``blocked`` (views still reference it: the
    foreign key has no cascade), else ``deleted``."""
    docs = resumes.select(F.col("id"), F.col("created_by"), F.lit(True).alias("_exists"))
    viewed = views.select(F.col("resume_id").alias("id")).distinct() \
        .withColumn("_viewed", F.lit(True))
    return (requests.join(docs, "id", "left").join(viewed, "id", "left")
            .select("id", "user_id",
                    F.when(F.col("_exists").isNull(), F.lit("missing"))
                     .when(F.col("created_by") != F.col("user_id"), F.lit("not_owner"))
                     .when(F.col("_viewed").isNotNull(), F.lit("blocked"))
                     .otherwise(F.lit("deleted")).alias("status")))


def apply_deletes(resumes: DataFrame, permissions: DataFrame, status: DataFrame):
    """MUT-2: next versions of documents and of permissions (cascade)."""
    gone = status.filter(F.col("status") == "deleted").select("id").distinct()
    docs = resumes.join(gone, "id", "left_anti")
    perms = permissions.join(gone.withColumnRenamed("id", "resume_id"), "resume_id", "left_anti")
    return docs, perms
