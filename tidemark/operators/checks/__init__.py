"""Data-quality checks. Every check returns rows of ``tidemark.schemas.CHECK``."""
