"""Conversations and search logging: CNV-1..3, LOG-1/2.

Conversation folds are aggregates keyed by conversation. The history of a
conversation is emitted in parts of at most ``part_turns`` turns (by turn
number), so no single row or task has to hold an unbounded conversation;
the parts in order are the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.functions.ids import name_uuid
from talentscope.functions.text import or_default, token_estimate
from talentscope.operators import ttl as TTL
from talentscope.operators.validation import validate_search_requests
from talentscope.functions.text import search_cache_key
from talentscope.operators.joins import null_safe_join
from talentscope.operators.ordinal import ordinal
from talentscope.sources.buckets import BucketedTable

PART_TURNS = 50
#: Batch name of the conversations that searches create.
SEARCH_BATCH = "search"
TITLE_LIMIT = S.VARCHAR_LIMITS["conversations"]["title"]


def conversation_titles(turns: DataFrame) -> DataFrame:
    """CNV-1: a conversation started by a query takes that query as its title:
    the first user turn. ``title_too_long`` flags titles over VARCHAR(255)."""
    firsts = (turns.filter(F.col("role") == "user")
              .groupBy("conv_id").agg(F.min_by("text", "turn").alias("title")))
    limit = S.VARCHAR_LIMITS["conversations"]["title"]
    return firsts.withColumn("title_too_long", F.length("title") > limit)


def conversation_ownership(requests: DataFrame, owners: DataFrame) -> DataFrame:
    """CNV-2: ``new`` when no conversation is given (one is created), ``ok``
    when it exists and belongs to the caller, else ``forbidden``. Ids are
    compared as text, whatever their type."""
    own = owners.select(F.col("id").cast("string").alias("_conv"), F.col("user_id").alias("_owner"))
    keyed = requests.withColumn("_conv", F.col("conversation_id").cast("string"))
    return (keyed.join(own, "_conv", "left")
            .withColumn("conversation_status",
                        F.when(F.col("conversation_id").isNull(), F.lit("new"))
                         .when(F.col("_owner") == F.col("user_id"), F.lit("ok"))
                         .otherwise(F.lit("forbidden")))
            .drop("_conv", "_owner"))


def conversation_context(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """CNV-3: context of every conversation: the last user query, and the
    ordered user/assistant history as JSON ``[{role, content}, …]`` in parts
    of at most ``part_turns`` turns (``part`` = turn // part_turns)."""
    talk = turns.filter(F.col("role").isin(*S.HISTORY_ROLES))
    last = (talk.filter(F.col("role") == "user").groupBy("conv_id")
            .agg(F.max_by("text", "turn").alias("last_query")))
    parts = (talk.groupBy("conv_id", F.floor(F.col("turn") / part_turns).alias("part"))
             .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
             .select("conv_id", "part", F.size("_t").alias("n_turns"),
                     F.to_json(F.transform("_t", lambda m: F.struct(
                         m["role"].alias("role"), m["text"].alias("content")))).alias("history")))
    return parts.join(last, "conv_id", "left")


def eligible_requests(requests: DataFrame, owners: DataFrame, visible: DataFrame) -> DataFrame:
    """Requests that reach the cache: valid (VAL-1), conversation owned or new
    (checked for every request), and a caller with at least one visible
    document (otherwise the search returns early, logs and caches nothing)."""
    valid = validate_search_requests(requests).filter(F.col("valid")).drop("errors", "valid")
    owned = conversation_ownership(valid, owners).filter(
        F.col("conversation_status").isin("new", "ok"))
    users = visible.select("user_id").distinct()
    return owned.join(users, "user_id", "left_semi")


def response_explanation(responses: DataFrame) -> DataFrame:
    """Explanation of each model response; missing or empty gives the default."""
    parsed = F.from_json(F.coalesce(F.nullif(F.col("response"), F.lit("")), F.lit("{}")),
                         S.MODEL_RESPONSE)
    return responses.select(F.col("id"), or_default(parsed["explanation"], S.NO_EXPLANATION)
                            .alias("explanation"))


def derive_search_log(requests: DataFrame, owners: DataFrame, visible: DataFrame,
                      responses: DataFrame, ttl_s: int = S.SEARCH_CACHE_TTL_S) -> DataFrame:
    """LOG-1: the log row of every served search.

    Eligible requests are replayed through the result cache (TTL-1). A miss
    logs the model's explanation, a token estimate and ``cache_hit = false``
    (a new conversation gets a generated id, SCL-19 of the request); a
    hit logs the cached explanation (the one of the miss that stored the
    entry), NULL tokens and ``cache_hit = true``. Latency is not derivable
    in a batch and stays NULL.
    """
    reqs = eligible_requests(requests, owners, visible).withColumn(
        "cache_key", search_cache_key(F.col("user_id"), F.col("query")))
    replayed = TTL.replay(reqs, ["cache_key"], "requested_at", ttl_s, with_anchor=True)
    expl = response_explanation(responses).select(F.col("id").alias("anchor_id"), "explanation")
    served = replayed.join(expl, "anchor_id", "left")
    conv = F.when(F.col("hit") | F.col("conversation_id").isNotNull(), F.col("conversation_id")) \
        .otherwise(name_uuid("conversations", SEARCH_BATCH, F.col("id")))
    return served.select(
        "id", "user_id", "query", conv.alias("conversation_id"),
        F.col("explanation").alias("response"),
        F.when(F.col("hit"), F.lit(None).cast("int")).otherwise(token_estimate(F.col("explanation")))
         .alias("tokens_used"),
        F.lit(None).cast("int").alias("latency_ms"),
        F.col("hit").alias("cache_hit"),
        F.col("requested_at").alias("created_at"))


def derive_views(views: DataFrame, visible: DataFrame) -> DataFrame:
    """LOG-2: a view is logged only when it comes from a search (search log id
    present) and the viewer can see the document (else the read is a 404)."""
    return (views.filter(F.col("search_log_id").isNotNull())
            .join(visible, ["user_id", "resume_id"], "left_semi"))


def search_context_updates(requests: DataFrame, responses: DataFrame, matches: DataFrame,
                           history: bool = True) -> DataFrame:
    """CNV-3 + PRJ-4: the context a served search writes to its conversation:
    ``lastQuery``, ``lastResults`` (the matched documents projected to
    ``{id, name}``, in the caller's list order) and the history grown by the
    user query and the assistant explanation (left out without ``history``: a stored
    conversation keeps its history in parts, see ``append_history``).

    ``matches``: (response_id, resume_id, position, name) for the request's
    results; one request's results are bounded by its response, so folding
    them into one value per request is bounded too.
    """
    expl = response_explanation(responses)
    results = (matches.groupBy(F.col("response_id").alias("id"))
               .agg(F.array_sort(F.collect_list(F.struct("position", "resume_id", "name"))).alias("_r")))
    fields = [
        F.col("query").alias("lastQuery"),
        F.transform(F.coalesce(F.col("_r"), F.array().cast(results.schema["_r"].dataType)),
                    lambda x: F.struct(x["resume_id"].alias("id"), x["name"].alias("name")))
        .alias("lastResults")]
    if history:
        fields.append(F.array(
            F.struct(F.lit("user").alias("role"), F.col("query").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("explanation").alias("content")))
            .alias("history"))
    return (requests.select("id", "user_id", "query").join(expl, "id").join(results, "id", "left")
            .select("id", "user_id", F.to_json(F.struct(*fields)).alias("context")))


def created_conversations(served: DataFrame, requests: DataFrame) -> DataFrame:
    """Conversations that served searches without one create: titled by the query
    (a longer one than the column holds fails and creates none)."""
    fresh = requests.filter(F.col("conversation_id").isNull()).select("id")
    return (served.join(fresh, "id", "left_semi").filter(F.length("query") <= TITLE_LIMIT)
            .select(F.col("conversation_id").alias("id"), "user_id", F.col("query").alias("title"),
                    F.lit(None).cast("string").alias("context"), "created_at",
                    F.col("created_at").alias("updated_at")))


def search_updates(served: DataFrame, contexts: DataFrame) -> DataFrame:
    """The update that each served search sends for its conversation."""
    ctx = contexts.select("id", "context")
    return served.join(ctx, "id").select(
        F.lit(0).alias("kind"), F.col("id").alias("req_id"), F.col("conversation_id").alias("id"),
        "user_id", F.lit(None).cast("string").alias("title"), "context",
        F.col("created_at").alias("requested_at"))


def valid_conversation_updates(updates: DataFrame) -> DataFrame:
    """Updates that the table accepts: some field given, the title within its column."""
    given = F.col("title").isNotNull() | F.col("context").isNotNull()
    return updates.filter(given & (F.col("title").isNull() | (F.length("title") <= TITLE_LIMIT)))


def update_conversations(table: BucketedTable, created: DataFrame, updates: DataFrame) -> list[int]:
    """MUT-1 / CNV-3: merges new conversations and updates into the stored table and
    returns the rewritten buckets.

    Only the owner's updates count. In time order (kind and request id among equal
    times) each sets the fields it gives: every field ends with its last given value,
    found by one pre-aggregation per conversation, so a conversation with very many
    updates is no large group. ``updated_at`` is the last applied update's time."""
    when = F.struct("requested_at", "kind", "req_id")

    def last(field):
        return F.max_by(F.col(field), F.when(F.col(field).isNotNull(), when)).alias(f"new_{field}")
    # one row per conversation and user, with the user's say before the owner is known
    latest = updates.groupBy("id", "user_id").agg(
        last("title"), last("context"), F.max("requested_at").alias("at"))
    rows = created.select("id", "user_id", F.struct("title", "context", "created_at", "updated_at")
                          .alias("row"))
    changes = latest.join(rows, ["id", "user_id"], "full")

    def apply(current, changes):
        # a stored row wins over a new one of its id: the batch may be repeated
        fresh = changes.filter("row is not null").select("id", "user_id", "row.*").join(
            current.select("id"), "id", "left_anti")
        return current.unionByName(fresh).join(changes.drop("row"), ["id", "user_id"], "left").select(
            "id", "user_id", F.coalesce("new_title", "title").alias("title"),
            F.coalesce("new_context", "context").alias("context"), "created_at",
            F.coalesce("at", "updated_at").alias("updated_at"))
    return table.merge(changes, apply)


def history_parts(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(id, part, n_turns, history) of turns (id, turn, role, content): JSON of at most
    ``part_turns`` turns each, in order."""
    return (turns.groupBy("id", F.floor(F.col("turn") / part_turns).alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("t"))
            .select("id", "part", F.size("t").cast("long").alias("n_turns"),
                    F.to_json(F.transform("t", lambda m: F.struct(m["role"], m["content"])))
                    .alias("history")))


def search_turns(served: DataFrame, stored: DataFrame) -> DataFrame:
    """The two turns that each served search adds to its conversation, numbered behind
    the stored ones (id, turn), in time order; exact ordinals, so one conversation may
    hold most searches."""
    k = ordinal(served.select(F.col("conversation_id").alias("id"), F.col("id").alias("req_id"),
                              "query", "response", "created_at"),
                ["id"], [F.col("created_at").asc(), F.col("req_id").asc()], "k")
    ends = stored.groupBy("id").agg((F.max("turn") + 1).alias("n"))
    both = F.array(F.struct(F.lit(0).alias("i"), F.lit("user").alias("role"),
                            F.col("query").alias("content")),
                   F.struct(F.lit(1).alias("i"), F.lit("assistant").alias("role"),
                            F.col("response").alias("content")))
    return (null_safe_join(k, ends, ["id"], "left")
            .select("id", F.coalesce("n", F.lit(0)).alias("n"), "k", F.explode(both).alias("m"))
            .select("id", (F.col("n") + 2 * (F.col("k") - 1) + F.col("m.i")).alias("turn"),
                    "m.role", "m.content"))


HISTORY = "array<struct<role:string,content:string>>"


def append_history(table: BucketedTable, turns: DataFrame, part_turns: int = PART_TURNS) -> list[int]:
    """CNV-3: adds turns behind the stored history (id, part, n_turns, history); only
    the parts that grow, and new ones, are written."""
    def apply(current, fresh):
        fresh = fresh.select("id", "part", F.col("n_turns").alias("more"), F.col("history").alias("tail"))
        whole = F.concat(*[F.coalesce(F.from_json(c, HISTORY), F.array().cast(HISTORY))
                           for c in ("history", "tail")])
        return current.join(fresh, ["id", "part"], "full").select(
            "id", "part", (F.coalesce("n_turns", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_turns"),
            F.when(F.col("tail").isNull(), F.col("history")).otherwise(F.to_json(whole)).alias("history"))
    return table.merge(history_parts(turns, part_turns), apply)
