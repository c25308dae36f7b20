"""All registered queries and their SQL: importing the modules registers them."""

from . import queries_export, queries_formats, queries_ingest, queries_schema, queries_text  # noqa: F401
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
