"""What this subpackage adds to the entry point."""

from ckptlake.llm.queries import QUERIES
from ckptlake.llm.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
