"""Operators for preparing training data.

``queries()`` and ``oracle_sql()`` are what ``__spark_entry__.py`` registers.
Nothing outside this subpackage imports it.
"""

from fieldtally.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
