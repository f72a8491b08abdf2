"""Sinks: files, catalog tables, JDBC and previews."""

from opsframe.sinks.documents import write_documents_json, write_summary_json
from opsframe.sinks.tables import preview, write_csv, write_jdbc, write_table

__all__ = [
    "preview",
    "write_csv",
    "write_documents_json",
    "write_jdbc",
    "write_summary_json",
    "write_table",
]
