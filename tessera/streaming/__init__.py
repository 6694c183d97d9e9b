"""Incremental file jobs on Structured Streaming."""
