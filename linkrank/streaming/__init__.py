"""Incremental ingestion. The data model has no unbounded tables, so nothing else streams."""
