"""Per-user access: ACC-1..3, JON-2/3, SET-1/2, FLT-1/3/4, AGG-8.

Row-security policies become joins computed for every user at once:

* visible  = own ∪ shared with ``can_view``           (two SELECT policies)
* editable = (own ∪ shared with ``can_edit``) ∩ visible (UPDATE policies)

Permission rows are folded per (document, user) pair first (pre-aggregated, and
a pair is never hot), then joined to documents once, on the document id (the
existence check of the ``EXISTS`` policy and the owner lookup in one join). No
aggregate follows that needs the join's partitioning, so a document shared with
very many users, a skewed join key, can be split by AQE's skew join. Own pairs
need no shuffle at all: they are a projection of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.functions.time import DEFAULT_AS_OF, ts_ntz
from talentscope.operators.ordinal import ordinal


def own_pairs(resumes: DataFrame) -> DataFrame:
    return resumes.select(F.col("created_by").alias("user_id"), F.col("id").alias("resume_id"))


def permission_pairs(resumes: DataFrame, permissions: DataFrame) -> DataFrame:
    """One row per (document, user) with a permission row on an existing
    document: ``can_view`` / ``can_edit`` OR-ed over duplicate rows, plus owner."""
    docs = resumes.select(F.col("id").alias("resume_id"), F.col("created_by").alias("owner"))
    pairs = permissions.groupBy("resume_id", "user_id").agg(
        F.bool_or(F.coalesce(F.col("can_view"), F.lit(False))).alias("can_view"),
        F.bool_or(F.coalesce(F.col("can_edit"), F.lit(False))).alias("can_edit"))
    return pairs.join(docs, "resume_id", "inner")


def shared_documents(resumes: DataFrame, permissions: DataFrame) -> DataFrame:
    """JON-2: pairs granted through a ``can_view`` permission (``EXISTS`` policy)."""
    return (permission_pairs(resumes, permissions).filter(F.col("can_view"))
            .select("user_id", "resume_id"))


def visible_documents(resumes: DataFrame, permissions: DataFrame) -> DataFrame:
    """ACC-1 / SET-1: (user_id, resume_id) for every user, without duplicates."""
    shared = (permission_pairs(resumes, permissions)
              .filter(F.col("can_view") & (F.col("user_id") != F.col("owner")))
              .select("user_id", "resume_id"))
    return own_pairs(resumes).unionByName(shared)


def editable_documents(resumes: DataFrame, permissions: DataFrame) -> DataFrame:
    """SET-2 / JON-3: own rows, and rows shared with ``can_edit`` that are also visible."""
    shared = (permission_pairs(resumes, permissions)
              .filter(F.col("can_edit") & F.col("can_view") & (F.col("user_id") != F.col("owner")))
              .select("user_id", "resume_id"))
    return own_pairs(resumes).unionByName(shared)


def visible_counts(users: DataFrame, visible: DataFrame) -> DataFrame:
    """AGG-8: visible documents per user, zero included."""
    counts = visible.groupBy("user_id").agg(F.count(F.lit(1)).alias("visible_count"))
    return (users.select(F.col("id").alias("user_id"))
            .join(counts, "user_id", "left")
            .select("user_id", F.coalesce("visible_count", F.lit(0)).cast("long").alias("visible_count")))


def id_dictionary(resumes: DataFrame) -> DataFrame:
    """(resume_id, place): the place of every document id among all, from 0, for ids of
    any type that can be ordered (numbers, UUIDs). One range-partitioned sort of the
    distinct ids, with exact distributed ordinals."""
    ids = resumes.select(F.col("id").alias("resume_id")).distinct()
    return ordinal(ids, [], [F.col("resume_id").asc()], "place").select(
        "resume_id", (F.col("place") - 1).alias("place"))


def permission_index(visible: DataFrame, dictionary: DataFrame, as_of: str = DEFAULT_AS_OF,
                     ttl_s: int = S.PERMISSION_CACHE_TTL_S, block: int = 1000) -> DataFrame:
    """ACC-2: the id list of each user's visible documents, with the snapshot
    time and the end of its validity.

    The list is cut into blocks of ``block`` neighbouring ids of the dictionary (one row
    per user and block, ids ascending), so no row grows with the number of documents a
    user can see; the blocks of a user together are the list.
    """
    built = ts_ntz(as_of)
    return (visible.join(dictionary, "resume_id")
            .groupBy("user_id", F.floor(F.col("place") / block).alias("block"))
            .agg(F.array_sort(F.collect_list("resume_id")).alias("ids"))
            .select("user_id", "block", F.size("ids").alias("n_ids"),
                    F.array_join("ids", ",").alias("ids"),
                    built.alias("built_at"),
                    (built + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_s)))
                    .alias("valid_until")))


def insert_check(rows: DataFrame, writer_col: str = "writer_id") -> DataFrame:
    """ACC-3: a new document row is accepted only if ``created_by`` is the writer."""
    ok = F.coalesce(F.col("created_by") == F.col(writer_col), F.lit(False))
    return rows.withColumn("accepted", ok)


def own_rows(df: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """FLT-3 for all users at once: rows whose owner is a known user."""
    return df.join(users.select(F.col("id").alias(user_col)), user_col, "left_semi")


def role_rank(role):
    """FLT-4: rank of a role (NULL for an unknown role)."""
    m = F.create_map(*[x for k, v in S.ROLE_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, role)


def role_gate(users: DataFrame, gates: dict) -> DataFrame:
    """FLT-4: ``rank`` plus one boolean column per gate (name → required role)."""
    out = users.withColumn("rank", role_rank(F.col("role")))
    for name, required in gates.items():
        out = out.withColumn(name, F.coalesce(F.col("rank") >= F.lit(S.ROLE_RANK[required]),
                                              F.lit(False)))
    return out


def lookup_by_keys(table: DataFrame, keys: DataFrame, columns: list[str],
                   key: str = "id") -> DataFrame:
    """FLT-1 + SRT-3 for many keys: each requested key gets its row or none."""
    found = table.select(key, *columns, F.lit(True).alias("found"))
    return (keys.join(found, key, "left")
            .withColumn("found", F.coalesce(F.col("found"), F.lit(False))))
