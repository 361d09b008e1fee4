"""Registered conversation, logging and search queries (CNV, LOG, FTS, CRIT, CTX, RES)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.operators import access as ACC
from talentscope.operators import conversations as CNV
from talentscope.operators import mutations as MUT
from talentscope.operators import search as SR
from talentscope.operators import validation as VAL
from talentscope.operators.access import visible_documents
from talentscope.operators.text_index import TextIndex
from talentscope.plans.access_queries import (DELETE_STATUS_SQL, EDITABLE_SQL, UPDATE_ERRORS_SQL,
                                              VISIBLE_SQL)
from talentscope.plans.cache_queries import _walk_sql
from talentscope.plans.oracle_bindings import BINDINGS, conv_uuid, name_uuid_sql, utf16, with_ctes
from talentscope.plans.registry import register
from talentscope.session import cut_lineage, scratch_path
from talentscope.sources.bindings import Domain, conversation_uuid
from talentscope.sources.buckets import BucketedTable

TRIM = S.JS_TRIM_PATTERN
STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
TOKENS = S.TOKEN_SPLIT_PATTERN
ACCESS = ["users", "resumes", "resume_permissions"]


@register("conversation_titles", f"""
select conv_id, arg_min(text, turn) as title,
  length(arg_min(text, turn)) > {S.VARCHAR_LIMITS['conversations']['title']} as title_too_long
from conversations where role = 'user' group by conv_id""")
def q_conversation_titles(spark, sf_dir):
    return CNV.conversation_titles(Domain(spark, sf_dir).conversation_turns())




@register("conversation_ownership", with_ctes(["search_requests", "conversation_owner"], {}, f"""
select q.id, q.user_id, q.conversation_id,
  case when q.conversation_id is null then 'new' when o.user_id = q.user_id then 'ok' else 'forbidden' end
    as conversation_status
from search_requests q left join conversation_owner o on o.id = q.conversation_id"""))
def q_conversation_ownership(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return CNV.conversation_ownership(d.search_requests(), d.conversation_owner()).select(
        "id", "user_id", "conversation_id", "conversation_status")


@register("conversation_context", f"""
with talk as (select * from conversations where role in ('user', 'assistant')),
last as (select conv_id, arg_max(text, turn) as last_query from talk where role = 'user' group by conv_id),
parts as (select conv_id, floor(turn / {CNV.PART_TURNS}) as part, count(*) as n_turns,
  to_json(list({{'role': role, 'content': text}} order by turn)) as history
  from talk group by conv_id, floor(turn / {CNV.PART_TURNS}))
select p.conv_id, cast(p.part as bigint) as part, cast(p.n_turns as integer) as n_turns,
  cast(p.history as varchar) as history, l.last_query
from parts p left join last l on l.conv_id = p.conv_id""")
def q_conversation_context(spark, sf_dir):
    return CNV.conversation_context(Domain(spark, sf_dir).conversation_turns())


def _valid_search_sql(q: str = "") -> str:
    return (f"coalesce({q}query is not null and {utf16(q + 'query')} between 1 and {S.MAX_QUERY_CHARS} "
            f"and ({q}conversation_id is null or regexp_matches({q}conversation_id, '{S.UUID_PATTERN}')), false)")


def _search_log_head() -> str:
    ctes = {
        "vis": VISIBLE_SQL,
        "own": f"""select q.*, case when q.conversation_id is null then 'new'
               when o.user_id = q.user_id then 'ok' else 'forbidden' end as st
             from search_requests q left join conversation_owner o on o.id = q.conversation_id
             where {_valid_search_sql('q.')}""",
        "reqs": f"""select q.id, q.user_id, q.query, q.conversation_id, q.requested_at as ts,
               concat_ws(':', 'search', cast(q.user_id as varchar), regexp_replace(lower(q.query), '{TRIM}', '', 'g')) as key
             from own q where q.st in ('new', 'ok') and exists (select 1 from vis v where v.user_id = q.user_id)""",
        "expl": f"""select id, coalesce(nullif(json_extract_string(coalesce(nullif(response, ''), '{{}}'), '$.explanation'), ''),
               '{S.NO_EXPLANATION}') as explanation from model_responses""",
    }
    head = with_ctes(ACCESS + ["search_requests", "conversation_owner", "model_responses"], ctes, "")
    return head.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n"


NEW_CONVERSATION = name_uuid_sql("conversations", CNV.SEARCH_BATCH, "r.id")


def _search_log_oracle() -> str:
    out = """r.id, r.user_id, r.query,
  case when w.hit or r.conversation_id is not null then r.conversation_id else %s end
    as conversation_id,
  (select e.explanation from expl e where e.id = w.anchor_id) as response,
  case when w.hit then null else cast(ceil(length((select e.explanation from expl e where e.id = w.anchor_id)) / 4) as integer) end
    as tokens_used,
  cast(null as integer) as latency_ms, w.hit as cache_hit, r.ts as created_at""" % NEW_CONVERSATION
    return _search_log_head() + _walk_sql(S.SEARCH_CACHE_TTL_S, out)


@register("derive_search_log", _search_log_oracle())
def q_derive_search_log(spark, sf_dir):
    d = Domain(spark, sf_dir)
    vis = visible_documents(d.resumes(), d.resume_permissions())
    return CNV.derive_search_log(d.search_requests(), d.conversation_owner(), vis, d.model_responses())


@register("derive_views", with_ctes(ACCESS + ["resume_views"], {"vis": VISIBLE_SQL}, """
select v.* from resume_views v where v.search_log_id is not null
  and exists (select 1 from vis where vis.user_id = v.user_id and vis.resume_id = v.resume_id)"""))
def q_derive_views(spark, sf_dir):
    d = Domain(spark, sf_dir)
    vis = visible_documents(d.resumes(), d.resume_permissions())
    return CNV.derive_views(d.resume_views(), vis)


def _token_sql(id_expr: str, text: str, table: str) -> str:
    return (f"select {id_expr} as id, unnest(regexp_split_to_array(lower({text}), '{TOKENS}')) as token "
            f"from {table}")


INDEX_SQL = f"""select token, id as doc_id, count(*) as tf from ({_token_sql('id', 'content', 'resumes')})
  where length(token) > 0 and token not in ({STOP}) group by 1, 2"""


@register("token_index", with_ctes(["resumes"], {}, INDEX_SQL))
def q_token_index(spark, sf_dir):
    return SR.token_index(Domain(spark, sf_dir).resumes())


@register("text_match_all", with_ctes(["resumes"], {
    "idx": INDEX_SQL,
    "qt": f"""select distinct id as query_id, token from ({_token_sql('item_id', 'text', 'benchmark')})
          where length(token) > 0 and token not in ({STOP})""",
    "nq": "select query_id, count(*) as n from qt group by 1"}, """
select q.query_id, i.doc_id from qt q join nq using (query_id) join idx i on i.token = q.token
group by q.query_id, i.doc_id, nq.n having count(*) = nq.n"""))
def q_text_match_all(spark, sf_dir):
    """FTS-2 with the benchmark passages as queries (whole texts, AND of all terms)."""
    d = Domain(spark, sf_dir)
    queries = d.t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return SR.text_match_all(d.resumes().select("id", "content"), queries)


@register("indexed_text_search", with_ctes(
    ACCESS + ["update_requests", "resume_views", "delete_requests"], {
        "ed": EDITABLE_SQL,
        "new_text": f"""select id, first(content order by requested_at desc, req_id desc) as content from update_requests q
            where content is not null and coalesce({UPDATE_ERRORS_SQL} = '', false)
              and exists (select 1 from ed where ed.user_id = q.user_id and ed.resume_id = q.id) group by id""",
        "st": DELETE_STATUS_SQL,
        "now": """select r.id, coalesce(n.content, r.content) as content from resumes r left join new_text n on n.id = r.id
            where not exists (select 1 from st where st.id = r.id and st.status = 'deleted')""",
        "idx": f"""select distinct token, id as doc_id from ({_token_sql('id', 'content', 'now')})
            where length(token) > 0 and token not in ({STOP})""",
        "queries": """select concat('c', conv_id) as query_id, concat('java s', conv_id % 5, ' role', conv_id % 3, ' at c', conv_id % 11) as text
            from (select distinct conv_id from conversations)
            union all select concat('t', event_id), concat('text ', event_id) from events where event_id % 7 = 0""",
        "qt": f"""select distinct id as query_id, token from ({_token_sql('query_id', 'text', 'queries')})
            where length(token) > 0 and token not in ({STOP})""",
        "nq": "select query_id, count(*) as n from qt group by 1"}, """
select q.query_id, i.doc_id from qt q join nq using (query_id) join idx i on i.token = q.token
group by q.query_id, i.doc_id, nq.n having count(*) = nq.n"""))
def q_indexed_text_search(spark, sf_dir):
    """FTS-1/2 over a stored index: all documents are written, the ones whose text a
    batch of updates changed are indexed anew, both segments are merged (and the
    merged ones removed), a batch of deletes follows; then every conversation's terms and every new text are looked up."""
    d = Domain(spark, sf_dir)
    docs = d.resumes().select("id", "content")
    index = TextIndex(spark, scratch_path(spark, "index"), _buckets(spark))
    index.change(added=docs)
    upd = VAL.validate_documents(d.update_requests(), partial=True).filter(F.col("content").isNotNull())
    editable = ACC.editable_documents(d.resumes(), d.resume_permissions())
    changed = cut_lineage(MUT.apply_updates(docs, upd, editable, ["content"])
                          .filter(F.col("applied_updates") > 0).select("id", "content"))
    index.change(added=changed, deleted=changed)
    index.merge()
    index.vacuum()
    status = MUT.delete_status(d.resumes(), d.resume_views(), d.delete_requests())
    index.change(deleted=status.filter(F.col("status") == "deleted"))
    n = F.col("conv_id")
    lookups = d.t.conversations.select("conv_id").distinct().select(
        F.concat(F.lit("c"), n).alias("query_id"),
        F.concat(F.lit("java s"), n % 5, F.lit(" role"), n % 3, F.lit(" at c"), n % 11).alias("text"))
    texts = d.update_requests().filter(F.col("content").isNotNull()).select(
        F.concat(F.lit("t"), F.col("req_id")).alias("query_id"), F.col("content").alias("text"))
    return index.search(lookups.unionByName(texts))


CRIT_ORACLE_CTES = {
    "c": """select id as crit_id,
        list_transform(coalesce(cast(json_extract(criteria, '$.skills') as varchar[]), []), lambda s: lower(trim(s))) as skills,
        lower(trim(json_extract_string(criteria, '$.location'))) as location,
        lower(json_extract_string(criteria, '$.role')) as role,
        lower(json_extract_string(criteria, '$.experience')) as experience,
        cast(json_extract(criteria, '$.salary.min') as double) as smin,
        cast(json_extract(criteria, '$.salary.max') as double) as smax from criteria""",
    "d": """select id as doc_id,
        list_transform(coalesce(cast(json_extract(parsed_data, '$.skills') as varchar[]), []), lambda s: lower(trim(s))) as d_skills,
        lower(trim(json_extract_string(parsed_data, '$.location'))) as d_location,
        coalesce(json_transform(json_extract(parsed_data, '$.experience'), '[{"company":"VARCHAR","position":"VARCHAR","startDate":"VARCHAR","endDate":"VARCHAR","description":"VARCHAR"}]'), []) as d_exp,
        cast(json_extract(parsed_data, '$.salary_expectation') as double) as d_salary from resumes""",
}


@register("criteria_match", with_ctes(["criteria", "resumes"], CRIT_ORACLE_CTES, """
select crit_id, doc_id from c, d
where list_has_all(d_skills, skills)
  and (location is null or location = d_location)
  and (role is null or len(list_filter(d_exp, lambda e: lower(e.position) = role)) > 0)
  and (experience is null or len(list_filter(d_exp, lambda e: coalesce(contains(lower(e.position), experience), false)
                                     or coalesce(contains(lower(e.description), experience), false))) > 0)
  and ((smin is null and smax is null)
       or (d_salary is not null and (smin is null or d_salary >= smin) and (smax is null or d_salary <= smax)))"""))
def q_criteria_match(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return SR.criteria_match(d.criteria(), d.resumes())


RANKED_SQL = """select v.user_id, v.resume_id,
  row_number() over (partition by v.user_id order by r.created_at desc, r.id) as position
  from vis v join resumes r on r.id = v.resume_id"""


def _context_oracle() -> str:
    nl = "chr(10)"
    block = f"""concat('Resume ', k.position, ' (ID: ', r.id, '):', {nl}, 'Name: ', r.name, {nl}, 'Email: ', r.email, {nl},
      'Location: ', coalesce(nullif(json_extract_string(r.parsed_data, '$.location'), ''), '{S.NOT_SPECIFIED}'), {nl},
      'Skills: ', array_to_string(coalesce(cast(json_extract(r.parsed_data, '$.skills') as varchar[]), []), ', '), {nl},
      'Experience: ', array_to_string(list_transform(coalesce(json_transform(json_extract(r.parsed_data, '$.experience'), '[{{"company":"VARCHAR","position":"VARCHAR","startDate":"VARCHAR","endDate":"VARCHAR","description":"VARCHAR"}}]'), []),
          lambda e: coalesce(e.position, 'undefined') || ' at ' || coalesce(e.company, 'undefined')), '; '), {nl},
      'Education: ', array_to_string(list_transform(coalesce(json_transform(json_extract(r.parsed_data, '$.education'), '[{{"institution":"VARCHAR","degree":"VARCHAR","field":"VARCHAR","graduationDate":"VARCHAR"}}]'), []),
          lambda e: coalesce(e.degree, 'undefined') || ' in ' || coalesce(e.field, 'undefined')), '; '), {nl},
      'Salary Expectation: ', case when coalesce(cast(json_extract(r.parsed_data, '$.salary_expectation') as double), 0) = 0
          then '{S.NOT_SPECIFIED}'
          else concat('$', cast(cast(json_extract(r.parsed_data, '$.salary_expectation') as bigint) as varchar)) end)"""
    ctes = {"vis": VISIBLE_SQL, "ranked": RANKED_SQL,
            "blocks": f"select k.user_id, k.position, {block} as block from ranked k join resumes r on r.id = k.resume_id"}
    return with_ctes(ACCESS, ctes, f"""
select user_id, cast(floor((position - 1) / {SR.PART_DOCS}) as bigint) as part, cast(count(*) as integer) as n_docs,
  string_agg(block, chr(10) || chr(10) order by position) as context
from blocks group by 1, 2""")


@register("prompt_context", _context_oracle())
def q_prompt_context(spark, sf_dir):
    d = Domain(spark, sf_dir)
    ranked = SR.ranked_visible(d.resumes(), d.resume_permissions())
    return SR.prompt_context(d.resumes(), ranked)


@register("resolve_matches", with_ctes(ACCESS + ["model_responses"], {
    "vis": VISIBLE_SQL, "ranked": RANKED_SQL,
    "r": "select id as response_id, user_id, coalesce(nullif(response, ''), '{}') as js from model_responses",
    "named": f"""select distinct response_id, user_id, unnest(cast(json_extract(js, '$.results') as bigint[])) as resume_id,
        coalesce(nullif(json_extract_string(js, '$.explanation'), ''), '{S.NO_EXPLANATION}') as explanation from r"""}, """
select n.response_id, n.user_id, n.resume_id, k.position, n.explanation
from named n join ranked k on k.user_id = n.user_id and k.resume_id = n.resume_id"""))
def q_resolve_matches(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return SR.resolve_matches(d.model_responses(), d.resumes(), d.resume_permissions())


#: Documents per part of the short form: few, so that the test tables give several parts.
SHORT_PART = 3


@register("prompt_context_short", with_ctes(ACCESS, {
    "vis": VISIBLE_SQL, "ranked": RANKED_SQL,
    "blocks": """select k.user_id, k.position, concat('Resume ', k.position, ' (ID: ', r.id, '):', chr(10),
        'Name: ', r.name, chr(10),
        'Skills: ', array_to_string(coalesce(cast(json_extract(r.parsed_data, '$.skills') as varchar[]), []), ', '), chr(10),
        'Experience: ', array_to_string(list_transform(coalesce(json_transform(json_extract(r.parsed_data, '$.experience'),
            '[{"company":"VARCHAR","position":"VARCHAR","startDate":"VARCHAR","endDate":"VARCHAR","description":"VARCHAR"}]'), []),
            lambda e: coalesce(e.position, 'undefined') || ' at ' || coalesce(e.company, 'undefined')), '; ')) as block
        from ranked k join resumes r on r.id = k.resume_id"""}, f"""
select user_id, cast(floor((position - 1) / {SHORT_PART}) as bigint) as part, cast(count(*) as integer) as n_docs,
  string_agg(block, chr(10) || chr(10) order by position) as context
from blocks group by 1, 2"""))
def q_prompt_context_short(spark, sf_dir):
    """CTX-1 short form (streaming route): ordinal, id, name, skills, experience."""
    d = Domain(spark, sf_dir)
    ranked = SR.ranked_visible(d.resumes(), d.resume_permissions())
    return SR.prompt_context(d.resumes(), ranked, short=True, part_docs=SHORT_PART)


def _served_head() -> str:
    """CTEs up to ``ctx``: every search that reached the model, with its conversation
    and the results its context names."""
    cols = f"""r.id, r.user_id, r.query, r.ts, r.conversation_id is null as is_new,
  coalesce(r.conversation_id, {NEW_CONVERSATION}) as conversation_id"""
    walk, _, final = _walk_sql(S.SEARCH_CACHE_TTL_S, cols).rpartition("\nselect r.id")
    ctes = {
        "served": f"select r.id{final} where not w.hit",
        "ranked": RANKED_SQL,
        "r": "select id as response_id, user_id, coalesce(nullif(response, ''), '{}') as js from model_responses",
        "named": """select distinct response_id, user_id, unnest(cast(json_extract(js, '$.results') as bigint[])) as resume_id
            from r""",
        "m": """select n.response_id, n.resume_id, k.position, d.name from named n
            join ranked k on k.user_id = n.user_id and k.resume_id = n.resume_id join resumes d on d.id = n.resume_id""",
        "res": "select response_id as id, list({'id': resume_id, 'name': name} order by position) as lr from m group by 1",
        "ctx": """select q.*, ex.explanation, coalesce(res.lr, []::struct(id bigint, name varchar)[]) as lr
            from served q join expl ex on ex.id = q.id left join res on res.id = q.id"""}
    return _search_log_head() + walk + ",\n" + ",\n".join(f"{k} as ({v})" for k, v in ctes.items())


@register("search_context_updates", _served_head() + """
select id, user_id, cast(to_json({'lastQuery': query, 'lastResults': lr,
    'history': [{'role': 'user', 'content': query}, {'role': 'assistant', 'content': explanation}]}) as varchar)
  as context
from ctx""")
def q_search_context_updates(spark, sf_dir):
    """CNV-3: contexts written by the searches that reached the model: the misses
    of the search log (invalid, forbidden and cached requests write none)."""
    d = Domain(spark, sf_dir)
    return CNV.search_context_updates(_served(d), d.model_responses(), _matches(d))


def _served(d: Domain):
    vis = visible_documents(d.resumes(), d.resume_permissions())
    return CNV.derive_search_log(d.search_requests(), d.conversation_owner(), vis,
                                 d.model_responses()).filter(~F.col("cache_hit"))


def _matches(d: Domain):
    return SR.resolve_matches(d.model_responses(), d.resumes(), d.resume_permissions()).join(
        d.resumes().select(F.col("id").alias("resume_id"), "name"), "resume_id")


def _bindings_first(head: str, names: list[str]) -> str:
    """``head`` with further bindings in front of its CTEs."""
    extra = ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in names)
    return head.replace("WITH RECURSIVE ", "WITH RECURSIVE " + extra + ",\n", 1)


def _conversation_updates_oracle() -> str:
    return _bindings_first(_served_head(), ["conversation_table", "conversation_updates"]) + f""",
upd as (
  select 0 as kind, id as req_id, conversation_id as id, user_id, cast(null as varchar) as title,
    cast(to_json({{'lastQuery': query, 'lastResults': lr}}) as varchar) as context, ts from ctx
  union all
  select 1, req_id, id, user_id, title, context, ts from conversation_updates
  where (title is not null or context is not null) and (title is null or length(title) <= {CNV.TITLE_LIMIT})),
stored as (
  select id, user_id, title, created_at, updated_at from conversation_table
  union all
  select conversation_id, user_id, query, ts, ts from served where is_new and length(query) <= {CNV.TITLE_LIMIT}),
ok as (select u.* from upd u where exists (select 1 from stored b where b.id = u.id and b.user_id = u.user_id)),
agg as (select id,
    first(title order by ts desc, kind desc, req_id desc) filter (where title is not null) as new_title,
    first(context order by ts desc, kind desc, req_id desc) filter (where context is not null) as new_context,
    max(ts) as at from ok group by id)
select b.id, b.user_id, coalesce(a.new_title, b.title) as title, a.new_context as context, b.created_at,
  coalesce(a.at, b.updated_at) as updated_at
from stored b left join agg a on a.id = b.id"""


def _buckets(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@register("apply_conversation_updates", _conversation_updates_oracle())
def q_apply_conversation_updates(spark, sf_dir):
    """MUT-1 / CNV-3: the stored conversations after a batch of searches (which create
    conversations and write contexts) and of direct updates, merged in place."""
    d = Domain(spark, sf_dir)
    rows = d.conversation_table()
    table = BucketedTable(spark, scratch_path(spark, "conversations"), rows.schema, ["id"],
                          _buckets(spark)).write(rows)
    served = cut_lineage(_served(d))
    contexts = CNV.search_context_updates(served, d.model_responses(), _matches(d), history=False)
    updates = CNV.search_updates(served, contexts).unionByName(
        CNV.valid_conversation_updates(d.conversation_updates()))
    CNV.update_conversations(table, CNV.created_conversations(served, d.search_requests()), updates)
    return table.read()


@register("append_conversation_history", _served_head() + f""",
talk as (
  select {conv_uuid('conv_id')} as id, turn, role, text as content, 0 as later from conversations
  where role in ('user', 'assistant')),
ends as (select {conv_uuid('conv_id')} as id, max(turn) + 1 as n from conversations where role in ('user', 'assistant') group by 1),
k as (select c.*, row_number() over (partition by conversation_id order by ts, id) as k from ctx c),
added as (
  select conversation_id as id, coalesce(n, 0) + 2 * (k - 1) as turn, query, explanation from k left join ends on ends.id = k.conversation_id),
turns as (
  select id, turn, role, content from talk
  union all select id, turn, 'user', query from added
  union all select id, turn + 1, 'assistant', explanation from added)
select id, cast(floor(turn / {CNV.PART_TURNS}) as bigint) as part, count(*) as n_turns,
  cast(to_json(list({{'role': role, 'content': content}} order by turn)) as varchar) as history
from turns group by 1, 2""")
def q_append_conversation_history(spark, sf_dir):
    """CNV-3: the history of every conversation, stored in parts, after the searches
    of a batch added their turns behind it."""
    d = Domain(spark, sf_dir)
    turns = d.conversation_turns().filter(F.col("role").isin(*S.HISTORY_ROLES)).select(
        conversation_uuid(F.col("conv_id")).alias("id"), "turn", "role", F.col("text").alias("content"))
    parts = CNV.history_parts(turns)
    table = BucketedTable(spark, scratch_path(spark, "history"), parts.schema, ["id", "part"],
                          _buckets(spark)).write(parts)
    CNV.append_history(table, CNV.search_turns(_served(d), turns))
    return table.read()
