"""The order in which a reader expects each report.

Operators return unsorted frames, as a global sort of a large result is a shuffle
nobody may need. Sort at the end, or after filtering to one name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_ORDER = {
    "top_relations": ("target", "rank"),
    "ancestors": ("member", "depth", "role"),
    "descendants": ("role", "depth", "member"),
    "effective_privileges": ("role", "scope", "object_name", "privilege"),
    "column_report": ("relation_id", "ordinal"),
    "constraint_report": ("relation_id", "position", "con_name"),
    "index_report": ("relation_id", "position", "index_name"),
    "relation_grants": ("relation_id", "grantee", "privilege"),
    "schema_contents": ("target", "schema_name", "kind", "relation_name"),
    "default_privileges": ("schema_name", "object_type", "grantee"),
    "role_roster": ("name",),
    "schema_roster": ("target", "schema_name"),
    "schema_grant_plan": ("request_id", "schema_name", "grantee", "position"),
    "handover_plan": ("target", "name", "phase", "statement"),
    "triage": ("target", "rank"),
    "user_roster": ("username",),
    "instance_roster": ("identifier",),
    "health": ("position", "target", "figure"),
}


def in_report_order(df: DataFrame, report: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in REPORT_ORDER[report]])
