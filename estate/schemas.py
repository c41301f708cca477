"""Declared schemas of the snapshot tables, by kind."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "relations": (
        "relation_id bigint, target string, schema_name string, relation_name string, "
        "relkind string, owner string, row_estimate bigint, size_bytes bigint"
    ),
    "namespaces": "target string, schema_name string, owner string",
    "columns": (
        "relation_id bigint, ordinal int, column_name string, data_type string, "
        "not_null boolean, identity_code string, default_expr string, comment string"
    ),
    "constraint_columns": (
        "relation_id bigint, con_name string, contype string, pos bigint, column_name string, "
        "ref_table string, ref_column string, del_code string, upd_code string"
    ),
    "index_columns": (
        "relation_id bigint, index_name string, pos bigint, column_name string, "
        "is_primary boolean, is_unique boolean, method string, size_bytes bigint, predicate string"
    ),
    "inherits": "child_id bigint, parent_id bigint, bounds string",
    "acl": (
        "scope string, object_name string, grantee string, privilege string, grantor string, "
        "grantable boolean"
    ),
    "schema_acl": (
        "schema_name string, grantee string, grantee_kind string, privilege string, "
        "grantor string, grantable boolean"
    ),
    "roles": (
        "role string, can_login boolean, superuser boolean, create_db boolean, create_role boolean"
    ),
    "members": "member string, role string, inherit boolean",
    "query_log": (
        "query_id string, user_name string, target string, status string, "
        "start_time timestamp_ntz, duration_s bigint, query_text string"
    ),
    "jobs": (
        "job_id bigint, connection_id bigint, status string, job_type string, "
        "start_time timestamp_ntz, rows_synced bigint"
    ),
    "cursor_state": "connection_id bigint, namespace string, stream string, state string",
    "metric_points": "scope string, metric string, ts timestamp_ntz, value double",
    "rename_log": (
        "target string, schema_name string, old_name string, new_name string, "
        "generated_at timestamp_ntz, dry_run boolean"
    ),
}

KINDS = tuple(_DDL)


def schema_of(kind: str) -> StructType:
    if kind not in _DDL:
        raise ValueError(f"unknown snapshot kind {kind!r}; one of {', '.join(KINDS)}")
    return StructType.fromDDL(_DDL[kind])
