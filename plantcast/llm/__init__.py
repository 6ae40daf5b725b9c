"""Operators that prepare text corpora, and the queries that apply them to whole tables."""
