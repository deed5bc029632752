"""Incremental ingestion of new collection files."""
