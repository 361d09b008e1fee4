"""Schemas, fixed values and rule tables of the document-search data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced, so they are
# stated here plainly, in their natural order, and used by name elsewhere.
# ---------------------------------------------------------------------------

# Roles and their rank (a caller passes a gate when rank >= required rank).
ROLE_RANK = {"viewer": 0, "manager": 1, "admin": 2}
DEFAULT_ROLE = "viewer"

# Time-to-live of cached things, seconds.
SEARCH_CACHE_TTL_S = 3600
PERMISSION_CACHE_TTL_S = 300
REPORT_CACHE_TTL_S = 300

# Top-k sizes and default windows.
DEFAULT_DAYS = 7
POPULAR_WINDOW_DAYS = 30
VIEWED_WINDOW_DAYS = 30
POPULAR_K_OVERVIEW = 10
POPULAR_K_SEARCHES = 20
MOST_VIEWED_K = 10
HISTORY_K = 50

# Upload intake.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
ALLOWED_UPLOAD_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "text/plain",
)
UPLOAD_ERR_MISSING = "No file provided"
UPLOAD_ERR_SIZE = "File too large. Maximum size is 10MB."
UPLOAD_ERR_TYPE = "Invalid file type. Allowed types: PDF, DOCX, TXT"

# Document structuring: patterns, heading keywords, defaults, error texts.
EMAIL_PATTERN = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
SECTION_KEYWORDS = (
    ("experience", ("EXPERIENCE", "EMPLOYMENT")),
    ("education", ("EDUCATION",)),
    ("skills", ("SKILLS",)),
    ("summary", ("SUMMARY", "OBJECTIVE")),
)
SKILL_SEPARATORS = r"[,;|]"
UNKNOWN_NAME = "Unknown"
ERR_NAME = "Could not extract name from resume"
ERR_EMAIL = "Could not extract email from resume"
ERR_SKILLS = "No skills found in resume"
ERR_EXPERIENCE = "No work experience found in resume"
ERR_NO_TEXT = "No text extracted"

# Search and context rendering.
NOT_SPECIFIED = "Not specified"
NO_EXPLANATION = "No explanation provided"
MAX_QUERY_CHARS = 500
HISTORY_ROLES = ("user", "assistant")
CHARS_PER_TOKEN = 4

# Cache key templates: search:{user}:{normalised query}, analytics:{type}:{days},
# permissions:{user}.
SEARCH_KEY_PREFIX = "search"
ANALYTICS_KEY_PREFIX = "analytics"
PERMISSION_KEY_PREFIX = "permissions"

# Full-text index: English stop words dropped from the token index (the short
# English stop list of the public Snowball project), and the token pattern.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was "
    "were be been being have has had having do does did doing a an the and but "
    "if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both "
    "each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now"
).split()
TOKEN_SPLIT_PATTERN = r"[^\p{L}\p{N}]+"

# Column limits of the stored tables (VARCHAR(n)), NOT NULL columns, enums.
VARCHAR_LIMITS = {
    "users": {"email": 255, "password_hash": 255, "name": 255},
    "resumes": {"name": 255, "email": 255, "phone": 50, "file_path": 500},
    "search_history": {"search_type": 50},
    "conversations": {"title": 255},
}
NOT_NULL_COLUMNS = {
    "users": ("email", "password_hash", "name", "role"),
    "resumes": ("name", "content", "created_by"),
    "resume_permissions": ("resume_id", "user_id", "granted_by"),
    "search_history": ("user_id", "query"),
    "conversations": ("user_id",),
    "search_logs": ("user_id", "query"),
    "resume_views": ("resume_id", "user_id"),
}
ENUM_COLUMNS = {"users": {"role": tuple(ROLE_RANK)}}

# Column defaults applied on insert (besides generated ids and timestamps).
INSERT_DEFAULTS = {
    "users": {"role": DEFAULT_ROLE},
    "resume_permissions": {"can_view": True, "can_edit": False},
    "search_history": {"results_count": 0, "search_type": "natural_language"},
    "search_logs": {"cache_hit": False},
}

# Time columns that default to the time of the insert.
TIME_DEFAULTS = {
    "users": ("created_at", "updated_at"),
    "resumes": ("created_at", "updated_at"),
    "resume_permissions": ("granted_at",),
    "search_history": ("created_at",),
    "conversations": ("created_at", "updated_at"),
    "search_logs": ("created_at",),
    "resume_views": ("viewed_at",),
}

# Foreign keys: (child table, child column, parent table, parent column).
FOREIGN_KEYS = (
    ("resumes", "created_by", "users", "id"),
    ("resume_permissions", "resume_id", "resumes", "id"),
    ("resume_permissions", "user_id", "users", "id"),
    ("resume_permissions", "granted_by", "users", "id"),
    ("search_history", "user_id", "users", "id"),
    ("conversations", "user_id", "users", "id"),
    ("search_logs", "user_id", "users", "id"),
    ("search_logs", "conversation_id", "conversations", "id"),
    ("resume_views", "resume_id", "resumes", "id"),
    ("resume_views", "user_id", "users", "id"),
    ("resume_views", "search_log_id", "search_logs", "id"),
)

# Keys that must be unique.
UNIQUE_KEYS = (
    ("users", ("id",)),
    ("users", ("email",)),
    ("resumes", ("id",)),
    ("resume_permissions", ("id",)),
    ("resume_permissions", ("resume_id", "user_id")),
    ("search_history", ("id",)),
    ("conversations", ("id",)),
    ("search_logs", ("id",)),
    ("resume_views", ("id",)),
)

# ---------------------------------------------------------------------------
# JavaScript string semantics expressed as Java/RE2 regex classes.
# ``\s`` and ``trim`` in JS cover Unicode spaces and line terminators; Java's
# ``\s`` does not, and Spark's ``trim`` strips only U+0020. Both engines
# accept ``\x{hhhh}``.
# ---------------------------------------------------------------------------
_JS_SPACE_NO_NL = (r"\t\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
                   r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}")
JS_SPACE = "[\\n" + _JS_SPACE_NO_NL + "]"
JS_SPACE_NO_NEWLINE = "[" + _JS_SPACE_NO_NL + "]"
# The same set as literal characters, for character-set trims.
JS_SPACE_CHARS = ("\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000\ufeff")
# ``\z`` (end of text) rather than ``$``: Java's ``$`` also matches before a
# final line terminator such as U+0085, which JS does not treat as a space.
JS_TRIM_PATTERN = "^" + JS_SPACE + "+|" + JS_SPACE + "+\\z"
JS_BLANK_PATTERN = "^" + JS_SPACE + "*\\z"


def _phone_pattern() -> str:
    """The phone pattern with JS ``\\d`` (ASCII digits) and ``\\s`` spelled out.

    Within one line a JS ``\\s`` can never be a newline, so with the newline
    left out of the class the pattern can run over a whole text and still find
    the first match of the first matching line.
    """
    sp = JS_SPACE_NO_NEWLINE[1:-1]
    return (r"(\+?[0-9]{1,3}[-." + sp + r"]?)?\(?[0-9]{3}\)?[-." + sp
            + r"]?[0-9]{3}[-." + sp + r"]?[0-9]{4}")


PHONE_PATTERN = _phone_pattern()
# Same matches, faster scan on the JVM: every match starts with a digit, '+'
# or '(', so a one-character lookahead rejects other start positions at once
# (RE2 has no lookaround, so SQL oracles use PHONE_PATTERN).
PHONE_PATTERN_JVM = "(?=[0-9+(])" + PHONE_PATTERN
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
# A valid e-mail address matches this, does not start with a dot and holds no two
# dots in a row (two lookaheads of the original that RE2 does not have).
EMAIL_SHAPE_PATTERN = r"^[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}\z"

# ---------------------------------------------------------------------------
# Test-table schemas (read with an explicit schema, never inferred).
# ---------------------------------------------------------------------------
NTZ = T.TimestampNTZType()

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", NTZ),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
    T.StructField("toxic", T.IntegerType()),
])
CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])
CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType()),
])
TABLE_SCHEMAS = {
    "events": EVENTS, "documents": DOCUMENTS, "labels": LABELS,
    "conversations": CONVERSATIONS, "customer": CUSTOMER,
}

# ---------------------------------------------------------------------------
# The stored tables (ids are UUIDs).
# ---------------------------------------------------------------------------
_TEXT, _INT, _FLAG = T.StringType(), T.IntegerType(), T.BooleanType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


STORED_TABLES = {
    "users": _table(id=_TEXT, email=_TEXT, password_hash=_TEXT, name=_TEXT, role=_TEXT,
                    created_at=NTZ, updated_at=NTZ),
    "resumes": _table(id=_TEXT, name=_TEXT, email=_TEXT, phone=_TEXT, content=_TEXT, parsed_data=_TEXT,
                      file_path=_TEXT, created_by=_TEXT, created_at=NTZ, updated_at=NTZ),
    "resume_permissions": _table(id=_TEXT, resume_id=_TEXT, user_id=_TEXT, can_view=_FLAG,
                                 can_edit=_FLAG, granted_by=_TEXT, granted_at=NTZ),
    "search_history": _table(id=_TEXT, user_id=_TEXT, query=_TEXT, results_count=_INT,
                             search_type=_TEXT, created_at=NTZ),
    "conversations": _table(id=_TEXT, user_id=_TEXT, title=_TEXT, context=_TEXT, created_at=NTZ,
                            updated_at=NTZ),
    "search_logs": _table(id=_TEXT, user_id=_TEXT, conversation_id=_TEXT, query=_TEXT, response=_TEXT,
                          tokens_used=_INT, latency_ms=_INT, cache_hit=_FLAG, created_at=NTZ),
    "resume_views": _table(id=_TEXT, resume_id=_TEXT, user_id=_TEXT, search_log_id=_TEXT,
                           viewed_at=NTZ),
}

# ---------------------------------------------------------------------------
# Nested JSON shapes.
# ---------------------------------------------------------------------------
EXPERIENCE_ENTRY = T.StructType([
    T.StructField("company", T.StringType()), T.StructField("position", T.StringType()),
    T.StructField("startDate", T.StringType()), T.StructField("endDate", T.StringType()),
    T.StructField("description", T.StringType()),
])
EDUCATION_ENTRY = T.StructType([
    T.StructField("institution", T.StringType()), T.StructField("degree", T.StringType()),
    T.StructField("field", T.StringType()), T.StructField("graduationDate", T.StringType()),
])
PARSED_DOCUMENT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("email", T.StringType()),
    T.StructField("phone", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("experience", T.ArrayType(EXPERIENCE_ENTRY)),
    T.StructField("education", T.ArrayType(EDUCATION_ENTRY)),
    T.StructField("location", T.StringType()),
    T.StructField("salary_expectation", T.DoubleType()),
])
CRITERIA = T.StructType([
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("experience", T.StringType()), T.StructField("location", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("salary", T.StructType([
        T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())])),
])
MODEL_RESPONSE = T.StructType([
    T.StructField("results", T.ArrayType(T.StringType())),
    T.StructField("explanation", T.StringType()),
])
EVENT_PROPS = T.StructType([T.StructField("k", T.LongType())])
