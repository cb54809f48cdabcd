"""Registered queries over the given tables."""

from . import change_queries, check_queries, job_queries, keyword_queries, page_queries, search_queries, text_queries  # noqa: F401  (registers)
from .registry import ORACLES, QUERIES  # noqa: F401
