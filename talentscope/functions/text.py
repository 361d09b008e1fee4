"""Scalar text functions with JavaScript string semantics (SCL-1..9, 13..16).

All are built-in Column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentscope import schemas as S


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row (a lambda that names an
    outer expression would evaluate it once per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def js_trim(c: Column) -> Column:
    """``String.prototype.trim``: strips Unicode spaces and line ends.

    A character-set trim (``btrim``) touches only the two ends of the string,
    unlike a regex replace, which scans all of it."""
    return F.btrim(c, F.lit(S.JS_SPACE_CHARS))


def js_is_blank(c: Column) -> Column:
    """``!line.trim()``: empty after a JS trim."""
    return F.length(js_trim(c)) == 0


def normalize_query(c: Column) -> Column:
    """SCL-1: ``toLowerCase().trim()``, the cache-key form of a query."""
    return js_trim(F.lower(c))


def search_cache_key(user: Column, query: Column) -> Column:
    """SCL-2: ``search:{user}:{normalised query}``."""
    return F.concat_ws(":", F.lit(S.SEARCH_KEY_PREFIX), user.cast("string"), normalize_query(query))


def analytics_cache_key(report_type: Column, days: Column) -> Column:
    return F.concat_ws(":", F.lit(S.ANALYTICS_KEY_PREFIX), report_type, days.cast("string"))


def contains_upper(c: Column, word: str) -> Column:
    """SCL-3: ``toUpperCase().includes(word)`` (a substring test)."""
    return F.upper(c).contains(word)


def split_lines(c: Column) -> Column:
    """SCL-4: ``split('\\n')``; a ``\\r`` stays on its line."""
    return F.split(c, "\n", -1)


def non_blank_lines(c: Column) -> Column:
    """PRS-1: lines of a text, blank ones dropped, the rest kept untrimmed."""
    return F.filter(split_lines(c), lambda line: ~js_is_blank(line))


def split_list(c: Column) -> Column:
    """SCL-5: split on ``, ; |``, trim each part, drop empty parts."""
    parts = F.transform(F.split(c, S.SKILL_SEPARATORS, -1), js_trim)
    return F.filter(parts, lambda p: F.length(p) > 0)


def utf16_length(c: Column) -> Column:
    """JS ``length``: UTF-16 code units, not code points."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def token_estimate(c: Column) -> Column:
    """SCL-9: ``Math.ceil(length / 4)``."""
    return F.ceil(utf16_length(c) / S.CHARS_PER_TOKEN).cast("int")


def or_default(c: Column, default) -> Column:
    """FLT-6: JS ``a || b`` for strings: missing or empty gives the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def first_or_default(arr: Column, default) -> Column:
    """SCL-15: ``arr[0] || default`` without an out-of-bounds error."""
    return F.coalesce(F.get(arr, 0), F.lit(default))


def int_param(c: Column, default: int) -> Column:
    """SCL-16: ``parseInt(x || 'd')``: leading digits, else the default."""
    digits = F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(default))
