"""Structured Streaming versions of the incremental collectors."""
