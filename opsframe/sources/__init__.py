"""Scans: files, pages, catalog tables and JDBC as DataFrames."""

from opsframe.sources.config import scan_config_tree, scan_services
from opsframe.sources.documents import (
    scan_document_pages,
    scan_documents,
    scan_grants_csv,
    scan_policy_list,
    scan_policy_map,
)
from opsframe.sources.logs import scan_log_lines, stream_log_lines
from opsframe.sources.metastore import scan_metastore
from opsframe.sources.objects import scan_object_listing
from opsframe.sources.records import scan_query_records
from opsframe.sources.tables import scan_parquet, scan_table

__all__ = [
    "scan_config_tree",
    "scan_document_pages",
    "scan_documents",
    "scan_grants_csv",
    "scan_log_lines",
    "scan_metastore",
    "scan_object_listing",
    "scan_parquet",
    "scan_policy_list",
    "scan_policy_map",
    "scan_query_records",
    "scan_services",
    "scan_table",
    "stream_log_lines",
]
