"""Schemas, readers, writers and the mapping of the benchmark tables."""
