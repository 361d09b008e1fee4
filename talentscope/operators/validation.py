"""Row validation, duplicate and foreign keys: VAL-1..4, VAL-6, JON-6 (VAL-5: ``sources.batches``).

Request rules collect every issue of a row (an ordered error list), as a
schema validator reports all issues together. Key checks are group-by counts;
foreign keys compare distinct keys first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.functions.text import utf16_length


def _errors(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda e: e.isNotNull())


def _rule(cond: Column, message: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(message))


def email_ok(c: Column) -> Column:
    return c.rlike(S.EMAIL_SHAPE_PATTERN) & ~c.startswith(".") & ~c.contains("..")


def bad_history_role(role: Column) -> Column:
    """VAL-1: a history message is from the user or the assistant."""
    return F.coalesce(~role.isin(*S.HISTORY_ROLES), F.lit(True))


def validate_search_requests(requests: DataFrame, history_col: str | None = None) -> DataFrame:
    """VAL-1: query 1–500 characters, conversation id a UUID when present,
    history roles in {user, assistant}."""
    q = F.col("query")
    rules = [
        _rule(q.isNull(), "query: Required"),
        _rule(F.length(q) < 1, "query: String must contain at least 1 character(s)"),
        _rule(utf16_length(q) > S.MAX_QUERY_CHARS,
              f"query: String must contain at most {S.MAX_QUERY_CHARS} character(s)"),
        _rule(F.col("conversation_id").isNotNull() & ~F.col("conversation_id").rlike(S.UUID_PATTERN),
              "conversationId: Invalid uuid"),
    ]
    if history_col:
        rules.append(_rule(F.exists(F.col(history_col), lambda m: bad_history_role(m["role"])),
                           "conversationHistory: Invalid enum value"))
    errs = _errors(*rules)
    return requests.withColumn("errors", errs).withColumn("valid", F.size(errs) == 0)


def validate_documents(rows: DataFrame, partial: bool = False) -> DataFrame:
    """VAL-2 (new document) and VAL-3 (update, ``partial``: each rule applies
    only to a supplied field): name ≥ 1 char, email shape, content a string."""
    name, email, content = F.col("name"), F.col("email"), F.col("content") \
        if "content" in rows.columns else F.lit("")
    if partial:
        rules = [
            _rule(name.isNotNull() & (F.length(name) < 1), "name: String must contain at least 1 character(s)"),
            _rule(email.isNotNull() & ~email_ok(email), "email: Invalid email"),
        ]
    else:
        rules = [
            _rule(name.isNull(), "name: Required"),
            _rule(F.length(name) < 1, "name: String must contain at least 1 character(s)"),
            _rule(email.isNull(), "email: Required"),
            _rule(email.isNotNull() & ~email_ok(email), "email: Invalid email"),
            _rule(content.isNull(), "content: Required"),
        ]
    errs = _errors(*rules)
    return rows.withColumn("errors", errs).withColumn("valid", F.size(errs) == 0)


def validate_users(rows: DataFrame) -> DataFrame:
    """VAL-4: registration rows: email shape, name ≥ 2 characters."""
    rules = [
        _rule(F.col("email").isNull() | ~email_ok(F.col("email")), "email: Invalid email"),
        _rule(F.col("name").isNull() | (utf16_length(F.col("name")) < 2),
              "name: Name must be at least 2 characters"),
    ]
    errs = _errors(*rules)
    return rows.withColumn("errors", errs).withColumn("valid", F.size(errs) == 0)


def duplicate_keys(tables: dict) -> DataFrame:
    """VAL-6: key values that occur more than once, with their count."""
    out = []
    for table, cols in S.UNIQUE_KEYS:
        if table not in tables:
            continue
        df = tables[table]
        out.append(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
                   .filter(F.col("n") > 1)
                   .select(F.lit(table).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"),
                           F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key_value"),
                           "n"))
    return reduce(DataFrame.unionByName, out)


def fk_violations(tables: dict) -> DataFrame:
    """JON-6: child rows whose non-NULL reference has no parent row.

    The child's keys are made distinct inside their tasks before any shuffle, and only
    they meet the parent's keys, in as many tasks as the session has shuffle partitions:
    AQE would join these by their compressed size, far below that of the keys in
    memory. What is left, the missing keys, is normally
    small, is then broadcast by AQE (by its measured size) and picks its rows from the
    child, which are not shuffled at all. So a key that holds a third of the child's
    rows costs one row a task.
    """
    out = []
    for child, col, parent, pcol in S.FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        c, p = tables[child], tables[parent]
        used = c.select(F.col(col).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
        n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        missing = used.join(p.select(F.col(pcol).alias("_k")).repartition(n, "_k"), "_k", "left_anti")
        orphans = c.join(missing, F.col(col) == F.col("_k"), "left_semi")
        out.append(orphans.select(F.lit(child).alias("child_table"), F.lit(col).alias("column_name"),
                                  F.lit(parent).alias("parent_table"),
                                  F.col("id").cast("string").alias("child_id"),
                                  F.col(col).cast("string").alias("missing_key")))
    return reduce(DataFrame.unionByName, out)
