"""Registered queries: each operator on inputs derived from the given tables."""

from estate_queries import describe, grants, ingest, orphans, platform, querylog, roles, storage

MODULES = (storage, querylog, roles, orphans, describe, grants, ingest, platform)
