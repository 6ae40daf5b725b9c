"""Structured Streaming jobs over the same functions as the batch plans."""
