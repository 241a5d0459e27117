"""Readers, the raw table, the feature store and other sinks."""
