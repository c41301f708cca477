"""Operators that run continuously on Structured Streaming."""
