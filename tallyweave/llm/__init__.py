"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` list the ``opN_`` queries for ``__spark_entry__``.
"""

from __future__ import annotations

from importlib import import_module

#: One module for each operator, in the order of their numbers.
MODULES = (
    "bpe",
    "quality",
    "decontamination",
    "language_id",
    "language_model",
    "jaccard",
    "toxicity",
    "html_text",
    "token_shards",
    "media",
)


def queries() -> dict:
    """Every ``opN_`` query by name."""
    found = {}
    for name in MODULES:
        found.update(import_module(f"{__name__}.{name}").QUERIES)
    return found


def oracle_sql() -> dict:
    """DuckDB SQL of those queries that SQL can express."""
    found = {}
    for name in MODULES:
        found.update(getattr(import_module(f"{__name__}.{name}"), "ORACLE_SQL", {}))
    return found
