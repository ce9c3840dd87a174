"""Incremental landing of newly arrived quarters."""
