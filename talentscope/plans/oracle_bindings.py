"""DuckDB text of the domain bindings, inlined as CTEs into oracle SQL.

Same definitions as ``talentscope.sources.bindings`` (FIXTURES.md), written
for DuckDB, which sees only the raw test tables.
"""

from __future__ import annotations

from talentscope.sources.bindings import EXPERIENCE_TEXTS

N_USERS = "(select max(user_id)+1 from events)"
N_DOCS = "(select count(*) from documents)"
N_CONVS = "(select count(distinct conv_id) from conversations)"


def utf16(x: str) -> str:
    """UTF-16 units of a text: its characters, those beyond the first plane twice."""
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def conv_uuid(x: str) -> str:
    return f"concat('00000000-0000-4000-8000-',lpad(cast({x} as varchar),12,'0'))"


def minutes(x: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(cast({x} as integer)))"


def name_uuid_sql(table: str, batch: str, *key: str) -> str:
    """SCL-19 of key expressions, from the digest's hex digits."""
    name = " || '/' || ".join([f"'{table}/{batch}'", *(f"coalesce(cast({k} as varchar), '')" for k in key)])
    h = f"md5({name})"
    return (f"concat(substr({h},1,8),'-',substr({h},9,4),'-3',substr({h},14,3),'-',"
            f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab'),substr({h},18,3),'-',substr({h},21,12))")


BINDINGS = {
    "search_logs": f"""
select event_id as id, user_id, {conv_uuid(f'(event_id % {N_CONVS})')} as conversation_id,
  case event_id % 3 when 0 then event_type when 1 then concat('  ',event_type) else upper(event_type) end as query,
  concat('answer ',event_type) as response,
  case when event_type='view' then null else cast(regexp_extract(props,'[0-9]+',0) as int) end as tokens_used,
  cast(floor(value*10) as int) as latency_ms, event_type='view' as cache_hit, ts as created_at from events""",
    "search_history": """
select event_id as id, user_id, concat(event_type,' ',cast(regexp_extract(props,'[0-9]+',0) as int)%10) as query,
  cast(floor(value) as int)%20 as results_count, 'natural_language' as search_type, ts as created_at from events""",
    "users": """
select c_custkey as id, concat(lower(replace(c_name,'#','.')),'@example.com') as email, concat('h',c_custkey) as password_hash,
  c_name as name, case c_mktsegment when 'BUILDING' then 'admin' when 'MACHINERY' then 'manager' else 'viewer' end as role
from customer""",
    "resumes": f"""
select doc_id as id, concat('Candidate ',doc_id) as name, concat('c',doc_id,'@example.org') as email, cast(null as varchar) as phone,
  concat(case when doc_id%41=9 then 'Unknown' else concat('Candidate ',doc_id) end,chr(10),
    case when doc_id%29=7 then '' else concat('c',doc_id,'@example.org',chr(10)) end,'SUMMARY',chr(10),text,chr(10),
    case when doc_id%31=5 then '' else concat('Technical Skills',chr(10),'java, sql;  spark|s',doc_id%5,chr(10)) end,
    case when doc_id%37=3 then '' else concat('Experience',chr(10),'role',doc_id%3,' at c',doc_id%11,chr(10)) end,
    case when doc_id%4=0 then concat('Skills: again',chr(10),'python,s',doc_id%7) else '' end) as content,
  concat('{{"skills":["s',doc_id%5,'","s',5+doc_id%7,'"],"experience":[{{"company":"c',doc_id%11,'","position":"role',doc_id%3,
    '","description":"Built ',source,' tools in team ',doc_id%13,'"}}],"education":[{{"degree":"d',doc_id%2,'","field":"f',doc_id%6,'"}}],"location":"',source,'","salary_expectation":',
    50000+(doc_id*37)%100000,'}}') as parsed_data,
  doc_id % {N_USERS} as created_by, {minutes('doc_id')} as created_at from documents""",
    "resume_permissions": f"""
select doc_id as id, doc_id as resume_id, (doc_id*7+3) % {N_USERS} as user_id, quality=1 as can_view, toxic=1 as can_edit,
  doc_id % {N_USERS} as granted_by from labels""",
    "resume_views": f"""
select event_id as id, (event_id*31) % {N_DOCS} as resume_id, user_id, case when event_id%4=0 then null else event_id end as search_log_id,
  ts as viewed_at from events where event_type in ('view','click')""",
    "resume_views_orphans": """
select event_id as id, (event_id*31) % (select count(*)+5 from documents) as resume_id, user_id,
  case when event_id%4=0 then null else event_id end as search_log_id, ts as viewed_at
from events where event_type in ('view','click')""",
    "conversation_owner": f"""
select distinct {conv_uuid('conv_id')} as id, conv_id % {N_USERS} as user_id from conversations""",
    "conversation_rows": f"""
select {conv_uuid('conv_id')} as id, conv_id % {N_USERS} as user_id, arg_min(text, turn) filter (where role='user') as title
from conversations group by conv_id""",
    "conversation_table": f"""
select id, user_id, case when length(title) <= 255 then title end as title, created_at, created_at as updated_at
from (select {conv_uuid('conv_id')} as id, conv_id % {N_USERS} as user_id, arg_min(text, turn) filter (where role='user') as title,
  {minutes('(conv_id % 43200)')} as created_at from conversations group by conv_id)""",
    "conversation_updates": f"""
select event_id as req_id, {conv_uuid(f'(event_id % {N_CONVS})')} as id,
  case when event_id%2=0 then (event_id % {N_CONVS}) % {N_USERS} else user_id end as user_id,
  case when event_id%9=0 then repeat('t',256) when event_id%3=0 then concat('Title ',event_id) end as title,
  case when event_id%4=1 then concat('{{"lastQuery":"q',event_id,'","lastResults":[]}}') end as context, ts from events""",
    "search_requests": f"""
select event_id as id, user_id, case when event_id%50=0 then '' when event_id%50=1 then repeat('x',501) else event_type end as query,
  case when event_id%7=0 then 'not-a-uuid' when event_id%7=1 then null
       when event_id%7<=3 then {conv_uuid('user_id')} else {conv_uuid('event_id')} end as conversation_id,
  ts as requested_at from events""",
    "update_requests": f"""
select event_id as req_id, case when event_id%2=0 then user_id else event_id % {N_DOCS} end as id, user_id, case when event_id%2=0 then concat('Renamed ',event_id) end as name,
  case when event_id%3=0 then concat('555-000-',lpad(cast(event_id%10000 as varchar),4,'0')) end as phone,
  case when event_id%5=0 then 'bad-email' when event_id%5=1 then concat('n',event_id,'@example.net') end as email,
  case when event_id%7=0 then concat('text ',event_id) end as content,
  case when event_id%7=1 then concat('{{"skills":["u',event_id,'"]}}') end as parsed_data,
  case when event_id%7=2 then concat('files/',event_id) end as file_path, ts as requested_at from events""",
    "delete_requests": f"""
select case when doc_id%17=0 then doc_id + {N_DOCS} else doc_id end as id, case when doc_id%2=1 then doc_id % {N_USERS} else (doc_id+1) % {N_USERS} end as user_id from documents""",
    "model_responses": f"""
select event_id as id, user_id, case when event_id%10=0 then null
  else concat('{{"results":[',event_id % {N_DOCS},',',(event_id*7) % {N_DOCS},',',user_id,',999999999]',
              case when event_id%3=0 then '' else ',"explanation":"why"' end,'}}') end as response from events""",
    "criteria": f"""
select id, case when id % 50 = 49 then '{{}}' else concat('{{', concat_ws(',',
    case when kind <= 2 then concat('"skills":["s',id%5,'"',case when id%2=0 then concat(',"s',5+id%7,'"') else '' end,']') end,
    case when kind = 3 or (kind <= 2 and id%3 = 0) then concat('"location":" SRC',id%20,'"') end,
    case when kind = 4 or (kind <= 2 and id%4 = 0) then concat('"role":"Role',id%3,'"') end,
    case when kind in (5, 7) or id%5 = 0 then case when id%2=0 then '"salary":{{"min":60000,"max":120000}}'
      when id%3=0 then '"salary":{{"min":99000}}' else '"salary":{{"max":90000}}' end end,
    case when kind >= 6 then concat('"experience":"',({list(EXPERIENCE_TEXTS)})[id%6+1],'"') end), '}}') end as criteria
from (select distinct conv_id as id, conv_id % 8 as kind from conversations)""",
    "uploads": """
select doc_id as id, case when doc_id%23<>11 then concat('f',doc_id,case doc_id%4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.txt' else '.exe' end) end as file_name,
  n_chars*1000 as size_bytes from documents""",
    "registrations": """
select c_custkey as id, case when c_custkey%7=3 then concat('new',c_custkey%50,'@example.com')
  else concat(lower(replace(c_name,'#','.')),case when c_custkey%9=0 then '' else '@example.com' end) end as email,
  case when c_custkey%11=0 then 'x' else c_name end as name, 'viewer' as role from customer""",
    "permission_events": f"""
select doc_id as id, (doc_id*7+3) % {N_USERS} as user_id, 'invalidate' as kind, {minutes('(doc_id*20) % 43200')} as at from labels""",
    "report_requests": """
select event_id as id, case when event_id%3=0 then 'searches' else 'overview' end as type,
  case when event_id%2=0 then 7 else 30 end as days, ts as requested_at from events""",
}


def with_bindings(names, body: str) -> str:
    """``WITH name AS (binding), … body``; extra CTEs can follow in ``body``
    by starting it with a comma-free ``select``."""
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in names)
    return f"WITH {ctes}\n{body}"


def with_ctes(names, extra: dict, body: str) -> str:
    """Bindings first, then named extra CTEs in order, then the body."""
    parts = [f"{n} AS ({BINDINGS[n]})" for n in names]
    parts += [f"{k} AS ({v})" for k, v in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
