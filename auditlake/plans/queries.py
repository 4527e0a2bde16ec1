"""All registered queries of the library's own operators."""

from . import corpus_queries, operator_queries, review_queries, source_queries, table_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
