"""All queries of this subpackage and their SQL."""

from duelframe.llm import documents_queries, pages_queries, word_queries  # noqa: F401
from duelframe.llm.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
