"""Registered access, validation and mutation queries (ACC, JON, SET, VAL, MUT, SNK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.functions.ids import name_uuid
from talentscope.functions.time import DEFAULT_AS_OF, epoch_micros
from talentscope.operators import access as ACC
from talentscope.operators import mutations as MUT
from talentscope.operators import validation as VAL
from talentscope.plans.oracle_bindings import name_uuid_sql, utf16, with_ctes
from talentscope.plans.registry import register
from talentscope.session import scratch_path
from talentscope.sources.batches import BatchTable, constraint_report
from talentscope.sources.bindings import Domain

# Oracles state the row-security policies literally: a (user, document) pair
# is visible when the user owns it OR a permission row EXISTS for it.
OWN = "r.created_by = u.id"
CAN = ("exists (select 1 from resume_permissions p where p.resume_id = r.id "
       "and p.user_id = u.id and p.{flag} = true)")
VISIBLE_SQL = f"""select u.id as user_id, r.id as resume_id from users u, resumes r
  where {OWN} or {CAN.format(flag='can_view')}"""
EDITABLE_SQL = f"""select u.id as user_id, r.id as resume_id from users u, resumes r
  where ({OWN} or {CAN.format(flag='can_edit')}) and ({OWN} or {CAN.format(flag='can_view')})"""
ACCESS_TABLES = ["users", "resumes", "resume_permissions"]
EMAIL_RE = S.EMAIL_SHAPE_PATTERN.replace("'", "''")
EMAIL_SQL = (f"(regexp_matches(email, '{EMAIL_RE}') and not starts_with(email, '.') "
             "and not contains(email, '..'))")


def _visible(d: Domain):
    return ACC.visible_documents(d.resumes(), d.resume_permissions())


@register("visible_documents", with_ctes(ACCESS_TABLES, {}, VISIBLE_SQL))
def q_visible_documents(spark, sf_dir):
    return _visible(Domain(spark, sf_dir))


@register("shared_documents", with_ctes(["resumes", "resume_permissions"], {}, """
select distinct p.user_id, p.resume_id from resume_permissions p
where p.can_view = true and exists (select 1 from resumes r where r.id = p.resume_id)"""))
def q_shared_documents(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return ACC.shared_documents(d.resumes(), d.resume_permissions())


@register("editable_documents", with_ctes(ACCESS_TABLES, {}, EDITABLE_SQL))
def q_editable_documents(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return ACC.editable_documents(d.resumes(), d.resume_permissions())


@register("visible_counts", with_ctes(ACCESS_TABLES, {"vis": VISIBLE_SQL}, """
select u.id as user_id, cast(count(v.resume_id) as bigint) as visible_count
from users u left join vis v on v.user_id = u.id group by u.id"""))
def q_visible_counts(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return ACC.visible_counts(d.users(), _visible(d))


def _permission_index_sql(id_sql: str) -> str:
    return with_ctes(ACCESS_TABLES, {
        "vis": VISIBLE_SQL,
        "dict": f"select id, {id_sql} as named, row_number() over (order by {id_sql}) - 1 as place from resumes"}, f"""
select user_id, cast(floor(place / 1000) as bigint) as block, cast(count(*) as integer) as n_ids,
  string_agg(cast(named as varchar), ',' order by named) as ids,
  TIMESTAMP '2024-01-31 00:00:00' as built_at,
  TIMESTAMP '2024-01-31 00:00:00' + INTERVAL {S.PERMISSION_CACHE_TTL_S} SECOND as valid_until
from vis join dict on dict.id = vis.resume_id group by 1, 2""")


@register("permission_index", _permission_index_sql("id"))
def q_permission_index(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return ACC.permission_index(_visible(d), ACC.id_dictionary(d.resumes()))


@register("permission_index_uuid", _permission_index_sql(name_uuid_sql("resumes", "fixture", "id")))
def q_permission_index_uuid(spark, sf_dir):
    """ACC-2 with UUIDs as document ids."""
    d = Domain(spark, sf_dir)

    def named(c):
        return name_uuid("resumes", "fixture", F.col(c))
    docs = d.resumes().withColumn("id", named("id"))
    shared = d.resume_permissions().withColumn("resume_id", named("resume_id"))
    return ACC.permission_index(ACC.visible_documents(docs, shared), ACC.id_dictionary(docs))


@register("insert_check", with_ctes(["resumes", "delete_requests"], {}, """
select r.id, r.created_by, q.user_id as writer_id, coalesce(r.created_by = q.user_id, false) as accepted
from resumes r join delete_requests q on q.id = r.id"""))
def q_insert_check(spark, sf_dir):
    d = Domain(spark, sf_dir)
    rows = d.resumes().select("id", "created_by").join(
        d.delete_requests().withColumnRenamed("user_id", "writer_id"), "id")
    return ACC.insert_check(rows).select("id", "created_by", "writer_id", "accepted")


# -- validation -------------------------------------------------------------

@register("validate_search_requests", with_ctes(["search_requests"], {}, f"""
select id, concat_ws('; ',
    case when query is null then 'query: Required' end,
    case when length(query) < 1 then 'query: String must contain at least 1 character(s)' end,
    case when {utf16('query')} > {S.MAX_QUERY_CHARS} then 'query: String must contain at most {S.MAX_QUERY_CHARS} character(s)' end,
    case when conversation_id is not null and not regexp_matches(conversation_id, '{S.UUID_PATTERN}')
         then 'conversationId: Invalid uuid' end,
    case when id % 11 = 0 or id % 13 = 0 then 'conversationHistory: Invalid enum value' end) as errors,
  coalesce(query is not null and {utf16('query')} between 1 and {S.MAX_QUERY_CHARS} and id % 11 <> 0 and id % 13 <> 0
   and (conversation_id is null or regexp_matches(conversation_id, '{S.UUID_PATTERN}')), false) as valid
from search_requests"""))
def q_validate_search_requests(spark, sf_dir):
    i = F.col("id")
    role = F.when(i % 11 == 0, "system").when(i % 13 != 0, "assistant")
    history = F.when(i % 3 > 0, F.array(*[F.struct(r.alias("role"), F.col("query").alias("content"))
                                          for r in (F.lit("user"), role)]))
    whole = F.when((i % 11 == 0) | (i % 13 == 0), F.array(F.struct(
        role.alias("role"), F.lit("x").alias("content")))).otherwise(history)
    requests = Domain(spark, sf_dir).search_requests().withColumn("history", whole)
    v = VAL.validate_search_requests(requests, "history")
    return v.select("id", F.array_join("errors", "; ").alias("errors"), "valid")


@register("validate_histories", """
select conv_id, count(*) as n_turns,
  count(*) filter (where role is null or role not in ('user', 'assistant')) as bad_roles,
  count(*) filter (where role is null or role not in ('user', 'assistant')) = 0 as valid
from conversations group by conv_id""")
def q_validate_histories(spark, sf_dir):
    """VAL-1 history rule per conversation, as an aggregate (no per-conversation array)."""
    t = Domain(spark, sf_dir).t.conversations
    bad = F.count_if(VAL.bad_history_role(F.col("role")))
    return (t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), bad.alias("bad_roles"))
            .withColumn("valid", F.col("bad_roles") == 0))


@register("validate_documents", with_ctes(["resumes"], {}, f"""
select id, concat_ws('; ',
    case when name is null then 'name: Required' end,
    case when length(name) < 1 then 'name: String must contain at least 1 character(s)' end,
    case when email is null then 'email: Required' end,
    case when email is not null and not {EMAIL_SQL} then 'email: Invalid email' end,
    case when content is null then 'content: Required' end) as errors
from (select id, coalesce(list_filter(string_split(content, chr(10)),
        lambda x: not regexp_matches(x, '{S.JS_BLANK_PATTERN}'))[5], '') as name,
      nullif(regexp_extract(content, '{S.EMAIL_PATTERN}', 1), '') as email, content from resumes)"""))
def q_validate_documents(spark, sf_dir):
    """VAL-2 on new-document rows built from each document's own text: the
    fifth non-blank line as the name (past the headings) and the extracted
    email (NULL when there is none)."""
    from talentscope.functions.text import non_blank_lines
    r = Domain(spark, sf_dir).resumes()
    rows = r.select("id", F.coalesce(F.get(non_blank_lines(F.col("content")), 4), F.lit("")).alias("name"),
                    F.nullif(F.regexp_extract("content", S.EMAIL_PATTERN, 1), F.lit("")).alias("email"),
                    "content")
    v = VAL.validate_documents(rows)
    return v.select("id", F.array_join("errors", "; ").alias("errors"))


UPDATE_ERRORS_SQL = f"""concat_ws('; ',
    case when name is not null and length(name) < 1 then 'name: String must contain at least 1 character(s)' end,
    case when email is not null and not {EMAIL_SQL} then 'email: Invalid email' end)"""


@register("validate_updates", with_ctes(["update_requests"], {}, f"""
select req_id, {UPDATE_ERRORS_SQL} as errors, {UPDATE_ERRORS_SQL} = '' as valid from update_requests"""))
def q_validate_updates(spark, sf_dir):
    v = VAL.validate_documents(Domain(spark, sf_dir).update_requests(), partial=True)
    return v.select("req_id", F.array_join("errors", "; ").alias("errors"), "valid")


USER_ERRORS_SQL = f"""concat_ws('; ',
    case when email is null or not {EMAIL_SQL} then 'email: Invalid email' end,
    case when name is null or {utf16('name')} < 2 then 'name: Name must be at least 2 characters' end)"""


@register("validate_users", with_ctes(["registrations"], {}, f"""
select id, {USER_ERRORS_SQL} as errors, {USER_ERRORS_SQL} = '' as valid from registrations"""))
def q_validate_users(spark, sf_dir):
    v = VAL.validate_users(Domain(spark, sf_dir).registrations())
    return v.select("id", F.array_join("errors", "; ").alias("errors"), "valid")


#: Rows that break a column rule: every (7 + number of the rule)-th of its table.
ROW_NUMBER = {"conversations": ("conversation_table", "cast(substr(id, 25, 12) as bigint)")}


def _rule_breaks(table: str):
    """(column, rule, limit) of a table's rules in the order of the report."""
    out = [(c, "not_null", None) for c in S.NOT_NULL_COLUMNS.get(table, ())]
    out += [(c, f"max_length_{n}", n) for c, n in S.VARCHAR_LIMITS.get(table, {}).items()]
    return out + [(c, "enum", None) for c in S.ENUM_COLUMNS.get(table, {})]


def _broken(df, table: str):
    """The table's rows, some of which break its rules (a later rule goes first)."""
    n = F.substring("id", 25, 12).cast("long") if table in ROW_NUMBER else F.col("id")
    df = df.withColumn("_n", n)
    for i, (c, rule, limit) in enumerate(_rule_breaks(table)):
        bad = (F.lit(None).cast("string") if rule == "not_null" else F.repeat(F.lit("y"), limit + 1)
               if limit else F.lit("owner"))
        old = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        df = df.withColumn(c, F.when(F.col("_n") % (7 + i) == i, bad).otherwise(old))
    return df


def _constraint_sql() -> str:
    parts = []
    for table in S.STORED_TABLES:
        source, number = ROW_NUMBER.get(table, (table, "id"))
        now: dict[str, str] = {}
        for i, (c, rule, limit) in enumerate(_rule_breaks(table)):
            bad = "null" if rule == "not_null" else f"repeat('y', {limit + 1})" if limit else "'owner'"
            old = now.get(c, "null" if (table, c) == ("resumes", "file_path") else f"cast({c} as varchar)")
            now[c] = f"case when {number} % {7 + i} = {i} then {bad} else {old} end"
        for c, rule, limit in _rule_breaks(table):
            v = now[c]
            if c in S.INSERT_DEFAULTS.get(table, {}):
                v = f"coalesce({v}, {S.INSERT_DEFAULTS[table][c]!r})"
            cond = (f"{v} is null" if rule == "not_null" else f"length({v}) > {limit}" if limit
                    else f"{v} not in ({', '.join(map(repr, S.ENUM_COLUMNS[table][c]))})")
            parts.append(f"select '{table}' as table_name, '{c}' as column_name, '{rule}' as rule, "
                         f"count(*) filter (where coalesce({cond}, false)) as violations from {source}")
    return "\nunion all\n".join(parts)


def _stored_sources(d: Domain):
    return {"users": d.users(), "resumes": d.resumes(), "resume_permissions": d.resume_permissions(),
            "search_history": d.search_history(), "conversations": d.conversation_table(),
            "search_logs": d.search_logs(), "resume_views": d.resume_views()}


@register("constraint_report", with_ctes(
    ["users", "resumes", "resume_permissions", "search_history", "conversation_table", "search_logs",
     "resume_views"], {}, _constraint_sql()))
def q_constraint_report(spark, sf_dir):
    """VAL-5: all tables loaded, with rows that break every rule; the counts are
    observed while the rows are written."""
    loaded = []
    for table, df in _stored_sources(Domain(spark, sf_dir)).items():
        stored = BatchTable(spark, scratch_path(spark, table), table)
        stored.append(_broken(df, table), "load", ["_n"])
        loaded.append(stored)
    return constraint_report(loaded)


def _dup_tables(d: Domain):
    users_after = d.users().select("id", "email").unionByName(d.registrations().select("id", "email"))
    return {"users": users_after, "resumes": d.resumes(), "resume_permissions": d.resume_permissions(),
            "search_history": d.search_history(), "conversations": d.conversations(),
            "search_logs": d.search_logs(), "resume_views": d.resume_views()}


def _dup_sql() -> str:
    src = {"users": "(select id, email from users union all select id, email from registrations)",
           "conversations": "conversation_rows"}
    parts = []
    for table, cols in S.UNIQUE_KEYS:
        t = src.get(table, table)
        key = "concat_ws('|', " + ", ".join(f"cast({c} as varchar)" for c in cols) + ")"
        parts.append(f"select '{table}' as table_name, '{','.join(cols)}' as key_columns, {key} as key_value, "
                     f"count(*) as n from {t} group by {', '.join(cols)} having count(*) > 1")
    return "\nunion all\n".join(parts)


@register("duplicate_keys", with_ctes(
    ["users", "registrations", "resumes", "resume_permissions", "search_history", "conversation_rows",
     "search_logs", "resume_views"], {}, _dup_sql()))
def q_duplicate_keys(spark, sf_dir):
    return VAL.duplicate_keys(_dup_tables(Domain(spark, sf_dir)))


def _fk_tables(d: Domain):
    return {"users": d.users(), "resumes": d.resumes(), "resume_permissions": d.resume_permissions(),
            "search_history": d.search_history(), "conversations": d.conversation_owner(),
            "search_logs": d.search_logs(), "resume_views": d.resume_views(id_space_extra=5)}


def _fk_sql() -> str:
    src = {"conversations": "conversation_owner", "resume_views": "resume_views_orphans"}
    parts = []
    for child, col, parent, pcol in S.FOREIGN_KEYS:
        c, p = src.get(child, child), src.get(parent, parent)
        parts.append(f"select '{child}' as child_table, '{col}' as column_name, '{parent}' as parent_table, "
                     f"cast(c.id as varchar) as child_id, cast(c.{col} as varchar) as missing_key from {c} c "
                     f"where c.{col} is not null and not exists (select 1 from {p} x where x.{pcol} = c.{col})")
    return "\nunion all\n".join(parts)


@register("fk_violations", with_ctes(
    ["users", "resumes", "resume_permissions", "search_history", "conversation_owner", "search_logs",
     "resume_views_orphans"], {}, _fk_sql()))
def q_fk_violations(spark, sf_dir):
    return VAL.fk_violations(_fk_tables(Domain(spark, sf_dir)))


# -- mutations --------------------------------------------------------------

#: Columns that the new rows of a batch supply; the rest are generated or defaults.
SUPPLIED = {
    "users": ("email", "password_hash", "name", "role"), "resumes": ("name", "email", "content", "created_by"),
    "resume_permissions": ("resume_id", "user_id", "can_view", "granted_by"),
    "search_history": ("user_id", "query"), "conversations": ("user_id", "title", "created_at"),
    "search_logs": ("user_id", "query", "response", "cache_hit"), "resume_views": ("resume_id", "user_id")}


def _row_text(table: str):
    cols = [F.when(F.col(f.name).isNull(), "~").otherwise(
        (epoch_micros(F.col(f.name)) if f.dataType == S.NTZ else F.col(f.name)).cast("string"))
        for f in S.STORED_TABLES[table].fields]
    return F.concat_ws("|", *cols)


def _append_sql() -> str:
    parts = []
    for table, schema in S.STORED_TABLES.items():
        source, number = ROW_NUMBER.get(table, (table, "id"))
        cols = []
        for f in schema.fields:
            given = f.name if f.name in SUPPLIED[table] else "null"
            if given != "null" and f.name in S.INSERT_DEFAULTS.get(table, {}):
                given = f"case when {number} % 3 > 0 then {f.name} end"
            if f.name == "id":
                v = name_uuid_sql(table, "b2", number)
            elif f.name in S.INSERT_DEFAULTS.get(table, {}):
                default = S.INSERT_DEFAULTS[table][f.name]
                v = f"coalesce({given}, {str(default).lower() if isinstance(default, bool) else repr(default)})"
            elif f.name in S.TIME_DEFAULTS[table]:
                v = f"epoch_us(coalesce(cast({given} as timestamp), TIMESTAMP '{DEFAULT_AS_OF}'))"
            else:
                v = given
            cols.append(f"coalesce(cast({v} as varchar), '~')")
        parts.append(f"select '{table}' as table_name, concat_ws('|', {', '.join(cols)}) as row_text from {source}")
    return "\nunion all\n".join(parts)


@register("append_with_defaults", with_ctes(
    ["users", "resumes", "resume_permissions", "search_history", "conversation_table", "search_logs",
     "resume_views"], {}, _append_sql()))
def q_append_with_defaults(spark, sf_dir):
    """SNK-1: a batch of new rows of every table, without ids and with some columns left
    out, appended twice: the second time adds nothing."""
    out = None
    for table, df in _stored_sources(Domain(spark, sf_dir)).items():
        n = F.substring("id", 25, 12).cast("long") if table in ROW_NUMBER else F.col("id")
        optional = S.INSERT_DEFAULTS.get(table, {})
        rows = df.select(n.alias("_n"), *[
            F.when(n % 3 > 0, F.col(c)).alias(c) if c in optional else F.col(c) for c in SUPPLIED[table]])
        stored = BatchTable(spark, scratch_path(spark, table), table)
        for _ in range(2):
            stored.append(rows, "b2", ["_n"])
        part = stored.read().select(F.lit(table).alias("table_name"), _row_text(table).alias("row_text"))
        out = part if out is None else out.unionByName(part)
    return out


@register("insert_if_absent", with_ctes(["users", "registrations"], {
    "v": f"select *, coalesce({USER_ERRORS_SQL} = '', false) as valid from registrations",
    "firsts": "select email, min(id) as first_id from v where valid group by email"}, """
select v.id, v.email, v.name, coalesce(v.role, 'viewer') as role,
  case when not v.valid then 'invalid'
       when exists (select 1 from users u where u.email = v.email) then 'exists'
       when v.id <> f.first_id then 'duplicate' else 'inserted' end as status
from v left join firsts f on f.email = v.email"""))
def q_insert_if_absent(spark, sf_dir):
    d = Domain(spark, sf_dir)
    regs = d.registrations()
    return MUT.register_users(d.users(), regs, VAL.validate_users(regs)).select(
        "id", "email", "name", "role", "status")


def _update_oracle() -> str:
    ctes = {
        "ed": EDITABLE_SQL,
        "ok": f"""select * from update_requests q where coalesce({UPDATE_ERRORS_SQL} = '', false)
              and exists (select 1 from ed where ed.user_id = q.user_id and ed.resume_id = q.id)""",
        "agg": """select id,
              first(name order by requested_at desc, req_id desc) filter (where name is not null) as new_name,
              first(email order by requested_at desc, req_id desc) filter (where email is not null) as new_email,
              first(phone order by requested_at desc, req_id desc) filter (where phone is not null) as new_phone,
              first(content order by requested_at desc, req_id desc) filter (where content is not null) as new_content,
              first(parsed_data order by requested_at desc, req_id desc) filter (where parsed_data is not null) as new_parsed,
              first(file_path order by requested_at desc, req_id desc) filter (where file_path is not null) as new_path,
              max(requested_at) as upd, count(*) as n from ok group by id""",
    }
    body = """select r.id, coalesce(a.new_name, r.name) as name, coalesce(a.new_email, r.email) as email,
  coalesce(a.new_phone, r.phone) as phone, coalesce(a.new_content, r.content) as content,
  coalesce(a.new_parsed, r.parsed_data) as parsed_data, a.new_path as file_path, r.created_at, coalesce(a.upd, r.created_at) as updated_at,
  coalesce(a.n, 0) as applied_updates from resumes r left join agg a on a.id = r.id"""
    return with_ctes(ACCESS_TABLES + ["update_requests"], ctes, body)


@register("apply_updates", _update_oracle())
def q_apply_updates(spark, sf_dir):
    d = Domain(spark, sf_dir)
    base = d.resumes().select("id", "name", "email", "phone", "content", "parsed_data",
                              F.lit(None).cast("string").alias("file_path"), "created_at")
    upd = VAL.validate_documents(d.update_requests(), partial=True)
    editable = ACC.editable_documents(d.resumes(), d.resume_permissions())
    return MUT.apply_updates(base, upd, editable,
                             ["name", "email", "phone", "content", "parsed_data", "file_path"])


DELETE_STATUS_SQL = """
select q.id, q.user_id, case when r.id is null then 'missing' when r.created_by <> q.user_id then 'not_owner'
  when exists (select 1 from resume_views v where v.resume_id = q.id) then 'blocked' else 'deleted' end as status
from delete_requests q left join resumes r on r.id = q.id"""
DELETE_TABLES = ["resumes", "resume_permissions", "resume_views", "delete_requests"]


def _delete_status(d: Domain):
    return MUT.delete_status(d.resumes(), d.resume_views(), d.delete_requests())


@register("delete_status", with_ctes(DELETE_TABLES, {}, DELETE_STATUS_SQL))
def q_delete_status(spark, sf_dir):
    """MUT-2: what becomes of every delete request."""
    return _delete_status(Domain(spark, sf_dir))


@register("apply_deletes", with_ctes(DELETE_TABLES, {"st": DELETE_STATUS_SQL}, """
select id, name, created_by, created_at from resumes r
where not exists (select 1 from st where st.id = r.id and st.status = 'deleted')"""))
def q_apply_deletes(spark, sf_dir):
    """MUT-2: the documents after the deletes."""
    d = Domain(spark, sf_dir)
    docs, _ = MUT.apply_deletes(d.resumes(), d.resume_permissions(), _delete_status(d))
    return docs.select("id", "name", "created_by", "created_at")


@register("cascade_deletes", with_ctes(DELETE_TABLES, {"st": DELETE_STATUS_SQL}, """
select p.* from resume_permissions p
where not exists (select 1 from st where st.id = p.resume_id and st.status = 'deleted')"""))
def q_cascade_deletes(spark, sf_dir):
    """MUT-2: the permissions after the deletes (the rows of deleted documents go too)."""
    d = Domain(spark, sf_dir)
    _, perms = MUT.apply_deletes(d.resumes(), d.resume_permissions(), _delete_status(d))
    return perms.select("id", "resume_id", "user_id", "can_view", "can_edit", "granted_by")
