"""Registered ingest and scalar-function queries (PRS-1..8, SRC-2, SCL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.functions import text as TX
from talentscope.functions import time as TM
from talentscope.operators import ingest as I
from talentscope.functions.time import DEFAULT_AS_OF
from talentscope.plans.oracle_bindings import BINDINGS as BINDINGS_SQL, with_ctes
from talentscope.plans.registry import register
from talentscope.sources.bindings import Domain

BLANK = S.JS_BLANK_PATTERN
TRIM = S.JS_TRIM_PATTERN
AS_OF = f"TIMESTAMP '{DEFAULT_AS_OF}'"


def _heading_sql(x: str) -> str:
    parts = []
    for name, words in S.SECTION_KEYWORDS:
        cond = " or ".join(f"contains(upper({x}), '{w}')" for w in words)
        parts.append(f"when {cond} then '{name}'")
    return "case " + " ".join(parts) + " end"


# DuckDB form of the parse: lines with positions, headings, the last heading
# of each section and the next heading after it, then content per section.
PARSE_CTES = {
    "doc_ls": f"""select id, content, list_filter(string_split(content, chr(10)),
        lambda x: not regexp_matches(x, '{BLANK}')) as ls from resumes""",
    "tagged": f"""select id, line, i, {_heading_sql('line')} as h from (
        select id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as i from doc_ls)""",
    "last_h": "select id, h as section, max(i) as hpos from tagged where h is not null group by all",
    "bounds": """select l.id, l.section, l.hpos, coalesce(min(t.i), 2147483647) as epos
        from last_h l left join tagged t on t.id = l.id and t.h is not null and t.i > l.hpos
        group by all""",
    "sect": """select b.id, b.section, coalesce(string_agg(t.line, ' ' order by t.i), '') as txt,
        coalesce(string_agg(t.line, chr(10) order by t.i), '') as body, count(t.i) as n
        from bounds b left join tagged t on t.id = b.id and t.i > b.hpos and t.i < b.epos
        group by all""",
    "parsed": f"""select d.id, coalesce(d.ls[1], '{S.UNKNOWN_NAME}') as name,
        regexp_extract(d.content, '{S.EMAIL_PATTERN}', 1) as email,
        nullif(regexp_extract(d.content, '{S.PHONE_PATTERN}', 0), '') as phone,
        (select regexp_replace(s.txt, '{TRIM}', '', 'g') from sect s where s.id = d.id and s.section = 'summary') as summary,
        coalesce((select list_filter(list_transform(regexp_split_to_array(s.txt, '{S.SKILL_SEPARATORS}'),
                   lambda x: regexp_replace(x, '{TRIM}', '', 'g')), lambda x: length(x) > 0)
                  from sect s where s.id = d.id and s.section = 'skills'), []) as skills,
        (select s.body from sect s where s.id = d.id and s.section = 'experience') as experience,
        coalesce((select s.n from sect s where s.id = d.id and s.section = 'experience'), 0) as n_experience_lines,
        (select s.body from sect s where s.id = d.id and s.section = 'education') as education,
        coalesce((select s.n from sect s where s.id = d.id and s.section = 'education'), 0) as n_education_lines
        from doc_ls d""",
}


def explode_positions(df, array_col, pos_name, value_name):
    """(id, position, element) rows. The outer form keeps Spark from inferring a
    ``size(array) > 0`` filter and pushing the whole parse into it twice."""
    return (df.select("id", F.posexplode_outer(array_col).alias(pos_name, value_name))
            .filter(F.col(pos_name).isNotNull())
            .select("id", F.col(pos_name).cast("long").alias(pos_name), value_name))


def _parsed(spark, sf_dir):
    return I.structure(Domain(spark, sf_dir).resumes().select("id", "content"), "content",
                       keep=["id"])


@register("doc_lines", with_ctes(["resumes"], {"doc_ls": PARSE_CTES["doc_ls"]}, """
select id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from doc_ls"""))
def q_doc_lines(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return explode_positions(p, "lines", "line_no", "line")


@register("doc_contacts", with_ctes(["resumes"], PARSE_CTES,
                                    "select id, name, email, phone from parsed"))
def q_doc_contacts(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "name", "email", "phone")


@register("doc_sections", with_ctes(["resumes"], PARSE_CTES, """
select id, summary, array_to_string(skills, '|') as skills, cast(len(skills) as integer) as n_skills,
  experience, cast(n_experience_lines as integer) as n_experience_lines,
  education, cast(n_education_lines as integer) as n_education_lines from parsed"""))
def q_doc_sections(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return p.select(
        "id", "summary", F.array_join("skills", "|").alias("skills"),
        F.size("skills").alias("n_skills"),
        F.array_join("experience_lines", "\n").alias("experience"),
        F.coalesce(F.size("experience_lines"), F.lit(0)).alias("n_experience_lines"),
        F.array_join("education_lines", "\n").alias("education"),
        F.coalesce(F.size("education_lines"), F.lit(0)).alias("n_education_lines"))


@register("doc_skills", with_ctes(["resumes"], PARSE_CTES, """
select id, generate_subscripts(skills, 1) - 1 as pos, unnest(skills) as skill from parsed"""))
def q_doc_skills(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return explode_positions(p, "skills", "pos", "skill")


@register("doc_validation", with_ctes(["resumes"], PARSE_CTES, f"""
select id, concat_ws('; ',
    case when name is null or name = '{S.UNKNOWN_NAME}' then '{S.ERR_NAME}' end,
    case when coalesce(email, '') = '' then '{S.ERR_EMAIL}' end,
    case when len(skills) = 0 then '{S.ERR_SKILLS}' end,
    case when n_experience_lines = 0 then '{S.ERR_EXPERIENCE}' end) as errors,
  concat_ws('; ',
    case when name is null or name = '{S.UNKNOWN_NAME}' then '{S.ERR_NAME}' end,
    case when coalesce(email, '') = '' then '{S.ERR_EMAIL}' end,
    case when len(skills) = 0 then '{S.ERR_SKILLS}' end,
    '{S.ERR_EXPERIENCE}') as errors_as_written,
  (name is not null and name <> '{S.UNKNOWN_NAME}' and coalesce(email, '') <> ''
   and len(skills) > 0 and n_experience_lines > 0) as accepted
from parsed"""))
def q_doc_validation(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return p.select("id", F.array_join(I.error_list(), "; ").alias("errors"),
                    F.array_join(I.error_list(as_written=True), "; ").alias("errors_as_written"),
                    (F.size(I.error_list()) == 0).alias("accepted"))


UPLOAD_GATE_SELECT = f"""
select id, file_name, size_bytes,
  case lower(regexp_extract(file_name, '\\.([^.]+)\\z', 1)) when 'pdf' then '{S.ALLOWED_UPLOAD_TYPES[0]}'
    when 'docx' then '{S.ALLOWED_UPLOAD_TYPES[1]}' when 'txt' then 'text/plain'
    else 'application/octet-stream' end as mime_type,
  case when file_name is null then '{S.UPLOAD_ERR_MISSING}'
       when size_bytes > {S.MAX_UPLOAD_BYTES} then '{S.UPLOAD_ERR_SIZE}'
       when lower(regexp_extract(file_name, '\\.([^.]+)\\z', 1)) not in ('pdf', 'docx', 'txt') then '{S.UPLOAD_ERR_TYPE}'
  end as reason,
  (file_name is not null and size_bytes <= {S.MAX_UPLOAD_BYTES}
   and lower(regexp_extract(file_name, '\\.([^.]+)\\z', 1)) in ('pdf', 'docx', 'txt')) as accepted
from uploads"""


@register("upload_gate", with_ctes(["uploads"], {}, UPLOAD_GATE_SELECT))
def q_upload_gate(spark, sf_dir):
    return I.upload_gate(Domain(spark, sf_dir).uploads())


INGEST_CTES = dict(PARSE_CTES)
INGEST_CTES["sect_lines"] = """select b.id, b.section,
    coalesce(list(t.line order by t.i) filter (where t.i is not null), []) as lines
    from bounds b left join tagged t on t.id = b.id and t.i > b.hpos and t.i < b.epos
    group by all"""
_NO_EXP = "coalesce(len(e.lines), 0) = 0"
# PRS-8 in DuckDB: the parse of ``PARSE_CTES``, the section lines as lists, and
# the stored record written as JSON the way Spark's ``to_json`` writes it
# (fields in record order, NULL fields left out).
INGEST_SELECT = f"""
select r.id, r.created_by, p.name, p.email, p.phone, r.content,
  '{{' || concat_ws(',',
    '"name":' || to_json(p.name), '"email":' || to_json(p.email),
    '"phone":' || to_json(p.phone), '"summary":' || to_json(p.summary),
    '"skills":' || to_json(p.skills),
    '"experience":' || to_json(list_transform(e.lines, lambda x: {{'description': x}})),
    '"education":' || to_json(list_transform(u.lines, lambda x: {{'institution': x}}))) || '}}' as parsed_data,
  case when p.name is not null and p.name <> '{S.UNKNOWN_NAME}' and coalesce(p.email, '') <> ''
    and len(p.skills) > 0 and not ({_NO_EXP}) then 'accepted' else 'quarantined' end as status,
  concat_ws('; ',
    case when p.name is null or p.name = '{S.UNKNOWN_NAME}' then '{S.ERR_NAME}' end,
    case when coalesce(p.email, '') = '' then '{S.ERR_EMAIL}' end,
    case when len(p.skills) = 0 then '{S.ERR_SKILLS}' end,
    case when {_NO_EXP} then '{S.ERR_EXPERIENCE}' end) as errors
from resumes r join parsed p on p.id = r.id
left join sect_lines e on e.id = r.id and e.section = 'experience'
left join sect_lines u on u.id = r.id and u.section = 'education'"""


def _ingest_oracle() -> str:
    return with_ctes(["resumes"], INGEST_CTES, INGEST_SELECT)


@register("ingest_documents", _ingest_oracle())
def q_ingest_documents(spark, sf_dir):
    """PRS-8: every document parsed, validated, routed."""
    r = Domain(spark, sf_dir).resumes()
    return I.ingest(r.select("id", "created_by", "content"))


NO_TEXT = 13      # every 13th upload of the test tables has no extracted text


def _pipeline_oracle() -> str:
    """Gate first; only uploads that pass it are parsed (``resumes`` is cut to
    them before the parse CTEs read it)."""
    ctes = {"all_resumes": BINDINGS_SQL["resumes"], "uploads": BINDINGS_SQL["uploads"],
            "gate": UPLOAD_GATE_SELECT,
            "resumes": f"select r.* from all_resumes r join gate g on g.id = r.id where g.accepted and r.id % {NO_TEXT} <> 0"}
    ctes.update(INGEST_CTES)
    ctes["ing"] = INGEST_SELECT
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + f"""
select id, created_by, status, case when status = 'accepted' then null else errors end as reason,
  name, email, phone, content, parsed_data,
  case when status = 'accepted' then {AS_OF} end as created_at,
  case when status = 'accepted' then {AS_OF} end as updated_at
from ing
union all
select g.id, r.created_by, 'rejected', g.reason, null, null, null, null, null, null, null
from gate g left join all_resumes r on r.id = g.id where not g.accepted
union all
select g.id, r.created_by, 'quarantined', '{S.ERR_NO_TEXT}', null, null, null, null, null, null, null
from gate g left join all_resumes r on r.id = g.id where g.accepted and r.id % {NO_TEXT} = 0"""


@register("ingest_pipeline", _pipeline_oracle())
def q_ingest_pipeline(spark, sf_dir):
    """PRS-8 + SRC-2 + SNK-1: every upload gated, parsed, validated and routed."""
    d = Domain(spark, sf_dir)
    text = F.when(F.col("id") % NO_TEXT != 0, F.col("content"))
    return I.ingest_pipeline(d.uploads(), d.resumes().select("id", "created_by",
                                                             text.alias("content")))


@register("scalar_text_functions", with_ctes(["search_requests"], {}, f"""
select id, concat_ws(':', 'search', cast(user_id as varchar),
         regexp_replace(lower(query), '{TRIM}', '', 'g')) as cache_key,
  cast(len(string_split(query, chr(10))) as integer) as n_lines,
  contains(upper(query), 'ERROR') as mentions_error,
  cast(ceil(length(query) / 4) as integer) as token_estimate,
  array_to_string([query, coalesce(conversation_id, '')], ' | ') as joined,
  case id % 4 when 0 then cast(id % 365 as integer) when 1 then cast(id % 90 as integer) else 7 end as days
from search_requests"""))
def q_scalar_text_functions(spark, sf_dir):
    r = Domain(spark, sf_dir).search_requests()
    i = F.col("id")
    days = (F.when(i % 4 == 0, (i % 365).cast("string")).when(i % 4 == 1, F.concat(F.lit(" +"), i % 90, F.lit("d")))
            .when(i % 4 == 2, ""))
    return r.select(
        "id", TX.search_cache_key(F.col("user_id"), F.col("query")).alias("cache_key"),
        F.size(TX.split_lines(F.col("query"))).alias("n_lines"),
        TX.contains_upper(F.col("query"), "ERROR").alias("mentions_error"),
        TX.token_estimate(F.col("query")).alias("token_estimate"),
        F.array_join(F.array(F.col("query"), F.coalesce("conversation_id", F.lit(""))), " | ")
         .alias("joined"), TX.int_param(days, S.DEFAULT_DAYS).alias("days"))


@register("scalar_time_functions", with_ctes(["search_logs"], {}, f"""
select id, cast(date_trunc('day', created_at) as timestamp) as day,
  created_at > TIMESTAMP '{TM.DEFAULT_AS_OF}' - INTERVAL 7 DAY as in_window,
  (epoch_us(TIMESTAMP '{TM.DEFAULT_AS_OF}') - epoch_us(created_at)) // 1000 as age_ms,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') as iso
from search_logs"""))
def q_scalar_time_functions(spark, sf_dir):
    logs = Domain(spark, sf_dir).search_logs()
    return logs.select(
        "id", TM.day_of(F.col("created_at")).alias("day"),
        TM.within_days(F.col("created_at"), TM.DEFAULT_AS_OF, 7).alias("in_window"),
        TM.elapsed_ms(F.col("created_at"), TM.ts_ntz(TM.DEFAULT_AS_OF)).alias("age_ms"),
        TM.iso_string(F.col("created_at")).alias("iso"))
