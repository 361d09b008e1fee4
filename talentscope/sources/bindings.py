"""Domain tables derived from the test tables (see FIXTURES.md).

Each binding is a projection (map-only) of one stored table; the few
table-size constants they need (number of users, documents, conversations)
are computed once per ``Domain`` and enter the plans as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.functions.time import plus_minutes
from talentscope.sources.tables import Tables

BASE_TIME = "2024-01-01 00:00:00"
#: Experience texts of the bound criteria: phrases, parts of words, one and two letters.
EXPERIENCE_TEXTS = ("Team 7", "src3 tools", "ROLE1", "m", "12", "no such text")


def _s(c):
    return c.cast("string")


def conversation_uuid(number):
    """The UUID that the test tables' conversation numbers stand for."""
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(_s(number), 12, "0"))


class Domain:
    """Domain views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = Tables(spark, sf_dir)
        # Stored timestamps are zone-less wall-clock values; the jobs read them
        # as UTC (epoch arithmetic, event-time windows), so the session must be
        # in UTC whichever session the caller hands in.
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    # -- table-size constants ------------------------------------------------
    # Each is one small aggregate job (a column min/max or a footer count),
    # run once per Domain and then used as a literal, so the plans that use
    # them carry no repeated sub-query scans.
    def _const(self, name, df):
        cache = self.__dict__.setdefault("_consts", {})
        if name not in cache:
            cache[name] = df.first()[0]
        return F.lit(cache[name])

    def n_users(self):
        return self._const("n_users", self.t.events.agg(F.max("user_id") + 1))

    def n_docs(self):
        return self._const("n_docs", self.t.documents.agg(F.count(F.lit(1))))

    def n_convs(self):
        # a scalar sub-query: pruned with the column where a plan does not use it
        return self.t.conversations.agg(F.count_distinct("conv_id")).scalar()

    # -- stored tables ------------------------------------------------------
    def search_logs(self) -> DataFrame:
        e = self.t.events
        m = F.col("event_id") % 3
        return e.select(
            F.col("event_id").alias("id"),
            "user_id",
            conversation_uuid(F.col("event_id") % self.n_convs()).alias("conversation_id"),
            F.when(m == 0, F.col("event_type"))
             .when(m == 1, F.concat(F.lit("  "), F.col("event_type")))
             .otherwise(F.upper("event_type")).alias("query"),
            F.concat(F.lit("answer "), F.col("event_type")).alias("response"),
            F.when(F.col("event_type") == "view", F.lit(None).cast("int"))
             .otherwise(F.regexp_extract("props", "[0-9]+", 0).cast("int")).alias("tokens_used"),
            F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
            (F.col("event_type") == "view").alias("cache_hit"),
            F.col("ts").alias("created_at"),
        )

    def search_history(self) -> DataFrame:
        e = self.t.events
        k = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 10
        return e.select(
            F.col("event_id").alias("id"),
            "user_id",
            F.concat(F.col("event_type"), F.lit(" "), _s(k)).alias("query"),
            (F.floor("value").cast("int") % 20).alias("results_count"),
            F.lit("natural_language").alias("search_type"),
            F.col("ts").alias("created_at"),
        )

    def users(self) -> DataFrame:
        c = self.t.customer
        return c.select(
            F.col("c_custkey").alias("id"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
                     F.lit("@example.com")).alias("email"),
            F.concat(F.lit("h"), _s(F.col("c_custkey"))).alias("password_hash"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_mktsegment") == "BUILDING", "admin")
             .when(F.col("c_mktsegment") == "MACHINERY", "manager")
             .otherwise("viewer").alias("role"),
        )

    def resumes(self) -> DataFrame:
        d = self.t.documents
        i = F.col("doc_id")
        nl = F.lit("\n")
        # some documents lack the name, the email, the skills or the experience
        skills = F.concat(F.lit("Technical Skills"), nl, F.lit("java, sql;  spark|s"), _s(i % 5), nl)
        work = F.concat(F.lit("Experience"), nl, F.lit("role"), _s(i % 3), F.lit(" at c"), _s(i % 11), nl)
        content = F.concat(
            F.when(i % 41 == 9, "Unknown").otherwise(F.concat(F.lit("Candidate "), _s(i))), nl,
            F.when(i % 29 == 7, "").otherwise(F.concat(F.lit("c"), _s(i), F.lit("@example.org"), nl)),
            F.lit("SUMMARY"), nl, F.col("text"), nl,
            F.when(i % 31 == 5, "").otherwise(skills), F.when(i % 37 == 3, "").otherwise(work),
            F.when(i % 4 == 0, F.concat(F.lit("Skills: again"), nl, F.lit("python,s"), _s(i % 7)))
             .otherwise(F.lit("")),
        )
        parsed = F.concat(
            F.lit('{"skills":["s'), _s(i % 5), F.lit('","s'), _s(5 + i % 7),
            F.lit('"],"experience":[{"company":"c'), _s(i % 11), F.lit('","position":"role'),
            _s(i % 3), F.lit('","description":"Built '), F.col("source"), F.lit(" tools in team "),
            _s(i % 13), F.lit('"}],"education":[{"degree":"d'), _s(i % 2), F.lit('","field":"f'),
            _s(i % 6), F.lit('"}],"location":"'), F.col("source"),
            F.lit('","salary_expectation":'), _s(50000 + (i * 37) % 100000), F.lit("}"),
        )
        return d.select(
            i.alias("id"),
            F.concat(F.lit("Candidate "), _s(i)).alias("name"),
            F.concat(F.lit("c"), _s(i), F.lit("@example.org")).alias("email"),
            F.lit(None).cast("string").alias("phone"),
            content.alias("content"),
            parsed.alias("parsed_data"),
            (i % self.n_users()).alias("created_by"),
            plus_minutes(BASE_TIME, i).alias("created_at"),
        )

    def resume_permissions(self) -> DataFrame:
        lab = self.t.labels
        n = self.n_users()
        return lab.select(
            F.col("doc_id").alias("id"),
            F.col("doc_id").alias("resume_id"),
            ((F.col("doc_id") * 7 + 3) % n).alias("user_id"),
            (F.col("quality") == 1).alias("can_view"),
            (F.col("toxic") == 1).alias("can_edit"),
            (F.col("doc_id") % n).alias("granted_by"),
        )

    def resume_views(self, id_space_extra: int = 0) -> DataFrame:
        """Views of documents. ``id_space_extra`` > 0 widens the id space so
        that some views point at documents that do not exist (FK test)."""
        e = self.t.events.filter(F.col("event_type").isin("view", "click"))
        n_docs = self.n_docs() + F.lit(id_space_extra)
        return e.select(
            F.col("event_id").alias("id"),
            ((F.col("event_id") * 31) % n_docs).alias("resume_id"),
            "user_id",
            F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("long"))
             .otherwise(F.col("event_id")).alias("search_log_id"),
            F.col("ts").alias("viewed_at"),
        )

    def conversation_owner(self) -> DataFrame:
        c = self.t.conversations.select("conv_id").distinct()
        return c.select(conversation_uuid(F.col("conv_id")).alias("id"),
                        (F.col("conv_id") % self.n_users()).alias("user_id"))

    def conversations(self) -> DataFrame:
        """Conversation rows: owner, and the first user turn as the title."""
        firsts = (self.t.conversations.filter(F.col("role") == "user").groupBy("conv_id")
                  .agg(F.min_by("text", "turn").alias("title")))
        rows = self.t.conversations.select("conv_id").distinct().join(firsts, "conv_id", "left")
        return rows.select(conversation_uuid(F.col("conv_id")).alias("id"),
                           (F.col("conv_id") % self.n_users()).alias("user_id"), "title")

    def conversation_table(self) -> DataFrame:
        """Stored conversation rows: titles that fit their column, no context yet."""
        rows = self.conversations()
        number = F.substring("id", 25, 12).cast("int")
        at = plus_minutes(BASE_TIME, number % 43200)
        return rows.select(
            "id", "user_id", F.when(F.length("title") <= 255, F.col("title")).alias("title"),
            F.lit(None).cast("string").alias("context"), at.alias("created_at"),
            at.alias("updated_at"))

    def conversation_updates(self) -> DataFrame:
        """One update per event for a stored conversation, every other one from its
        owner; titles that are too long, contexts, and updates that give nothing."""
        e = self.t.events
        i = F.col("event_id")
        conv = i % self.n_convs()
        return e.select(
            F.lit(1).alias("kind"), i.alias("req_id"), conversation_uuid(conv).alias("id"),
            F.when(i % 2 == 0, conv % self.n_users()).otherwise(F.col("user_id")).alias("user_id"),
            F.when(i % 9 == 0, F.repeat(F.lit("t"), 256))
             .when(i % 3 == 0, F.concat(F.lit("Title "), _s(i))).alias("title"),
            F.when(i % 4 == 1, F.concat(F.lit('{"lastQuery":"q'), _s(i), F.lit('","lastResults":[]}')))
             .alias("context"),
            F.col("ts").alias("requested_at"))

    def conversation_turns(self) -> DataFrame:
        return self.t.conversations

    # -- request tables -----------------------------------------------------
    def search_requests(self) -> DataFrame:
        e = self.t.events
        m50, m7 = F.col("event_id") % 50, F.col("event_id") % 7
        return e.select(
            F.col("event_id").alias("id"),
            "user_id",
            F.when(m50 == 0, F.lit("")).when(m50 == 1, F.repeat(F.lit("x"), 501))
             .otherwise(F.col("event_type")).alias("query"),
            F.when(m7 == 0, F.lit("not-a-uuid")).when(m7 == 1, F.lit(None).cast("string"))
             .when(m7 <= 3, conversation_uuid(F.col("user_id")))
             .otherwise(conversation_uuid(F.col("event_id"))).alias("conversation_id"),
            F.col("ts").alias("requested_at"),
        )

    def update_requests(self) -> DataFrame:
        """One update per event; every other one for a document that the user owns,
        so that updates of one row compete."""
        e = self.t.events
        i = F.col("event_id")
        return e.select(
            i.alias("req_id"),
            F.when(i % 2 == 0, F.col("user_id")).otherwise(i % self.n_docs()).alias("id"),
            "user_id",
            F.when(i % 2 == 0, F.concat(F.lit("Renamed "), _s(i))).alias("name"),
            F.when(i % 3 == 0, F.concat(F.lit("555-000-"), F.lpad(_s(i % 10000), 4, "0"))).alias("phone"),
            F.when(i % 5 == 0, F.lit("bad-email"))
             .when(i % 5 == 1, F.concat(F.lit("n"), _s(i), F.lit("@example.net"))).alias("email"),
            F.when(i % 7 == 0, F.concat(F.lit("text "), _s(i))).alias("content"),
            F.when(i % 7 == 1, F.concat(F.lit('{"skills":["u'), _s(i), F.lit('"]}'))).alias("parsed_data"),
            F.when(i % 7 == 2, F.concat(F.lit("files/"), _s(i))).alias("file_path"),
            F.col("ts").alias("requested_at"),
        )

    def delete_requests(self) -> DataFrame:
        """One delete request per document; every other one comes from its owner, and
        some name documents that do not exist."""
        d = self.t.documents
        n = self.n_users()
        i = F.col("doc_id")
        return d.select(
            F.when(i % 17 == 0, i + self.n_docs()).otherwise(i).alias("id"),
            F.when(i % 2 == 1, i % n).otherwise((i + 1) % n).alias("user_id"),
        )

    def model_responses(self) -> DataFrame:
        e = self.t.events
        i = F.col("event_id")
        nd = self.n_docs()
        body = F.concat(
            F.lit('{"results":['), _s(i % nd), F.lit(","), _s((i * 7) % nd), F.lit(","),
            _s(F.col("user_id")), F.lit(",999999999]"),
            F.when(i % 3 == 0, F.lit("")).otherwise(F.lit(',"explanation":"why"')), F.lit("}"))
        return e.select(i.alias("id"), "user_id",
                        F.when(i % 10 == 0, F.lit(None).cast("string")).otherwise(body).alias("response"))

    def criteria(self) -> DataFrame:
        """Criteria of every kind: skills with and without further fields, location, role,
        salary or experience text alone, text with a salary, and some that hold nothing."""
        c = self.t.conversations.select("conv_id").distinct()
        i = F.col("conv_id")
        kind = i % 8
        skills = F.concat(F.lit('"skills":["s'), _s(i % 5), F.lit('"'),
                          F.when(i % 2 == 0, F.concat(F.lit(',"s'), _s(5 + i % 7), F.lit('"')))
                          .otherwise(F.lit("")), F.lit("]"))
        words = F.element_at(F.array(*map(F.lit, EXPERIENCE_TEXTS)), (i % 6 + 1).cast("int"))
        text = F.concat(F.lit("{"), F.concat_ws(
            ",",
            F.when(kind <= 2, skills),
            F.when((kind == 3) | ((kind <= 2) & (i % 3 == 0)),
                   F.concat(F.lit('"location":" SRC'), _s(i % 20), F.lit('"'))),
            F.when((kind == 4) | ((kind <= 2) & (i % 4 == 0)),
                   F.concat(F.lit('"role":"Role'), _s(i % 3), F.lit('"'))),
            F.when(kind.isin(5, 7) | (i % 5 == 0),
                   F.when(i % 2 == 0, F.lit('"salary":{"min":60000,"max":120000}'))
                    .when(i % 3 == 0, F.lit('"salary":{"min":99000}'))
                    .otherwise(F.lit('"salary":{"max":90000}'))),
            F.when(kind >= 6, F.concat(F.lit('"experience":"'), words, F.lit('"')))), F.lit("}"))
        return c.select(i.alias("id"), F.when(i % 50 == 49, "{}").otherwise(text).alias("criteria"))

    def uploads(self) -> DataFrame:
        d = self.t.documents
        i = F.col("doc_id")
        ext = (F.when(i % 4 == 0, ".pdf").when(i % 4 == 1, ".docx")
               .when(i % 4 == 2, ".txt").otherwise(".exe"))
        name = F.when(i % 23 != 11, F.concat(F.lit("f"), _s(i), ext))
        return d.select(i.alias("id"), name.alias("file_name"),
                        (F.col("n_chars") * 1000).alias("size_bytes"))

    def registrations(self) -> DataFrame:
        c = self.t.customer
        k = F.col("c_custkey")
        return c.select(
            k.alias("id"),
            F.when(k % 7 == 3, F.concat(F.lit("new"), _s(k % 50), F.lit("@example.com"))).otherwise(
                F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
                         F.when(k % 9 == 0, F.lit("")).otherwise(F.lit("@example.com")))).alias("email"),
            F.when(k % 11 == 0, F.lit("x")).otherwise(F.col("c_name")).alias("name"),
            F.lit("viewer").alias("role"),
        )

    def permission_events(self) -> DataFrame:
        lab = self.t.labels
        i = F.col("doc_id")
        return lab.select(
            i.alias("id"),
            ((i * 7 + 3) % self.n_users()).alias("user_id"),
            F.lit("invalidate").alias("kind"),
            plus_minutes(BASE_TIME, (i * 20) % 43200).alias("at"),
        )

    def report_requests(self) -> DataFrame:
        e = self.t.events
        i = F.col("event_id")
        return e.select(
            i.alias("id"),
            F.when(i % 3 == 0, "searches").otherwise("overview").alias("type"),
            F.when(i % 2 == 0, 7).otherwise(30).alias("days"),
            F.col("ts").alias("requested_at"),
        )
