"""Incremental ingestion of arriving files."""
