"""The catalogue: every query by name, with DuckDB SQL of the same result."""

from .catalogue import QUERIES
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
