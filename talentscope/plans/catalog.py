"""Imports every query module so that all queries are registered."""

from talentscope.plans import analytics_queries  # noqa: F401
from talentscope.plans import ingest_queries  # noqa: F401
from talentscope.plans import access_queries  # noqa: F401
from talentscope.plans import cache_queries  # noqa: F401
from talentscope.plans import search_queries  # noqa: F401
from talentscope.plans import stream_queries  # noqa: F401
