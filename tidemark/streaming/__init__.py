"""Incremental ingestion and, as an extension, streaming resampling."""
