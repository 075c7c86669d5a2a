"""A relational analytics engine on PySpark: SQL and DataFrame operators, versioned tables, change feeds."""

from tessera.database import Database
from tessera.session import build_session, register_tables

__all__ = ["Database", "build_session", "register_tables"]
