"""Snapshots, landed pages, audit logs and sinks."""
