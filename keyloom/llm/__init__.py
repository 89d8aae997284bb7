"""Operators for large training-text corpora.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql`` hold what
``__spark_entry__.py`` registers.
"""

from keyloom.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
