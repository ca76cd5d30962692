"""Incremental scans over a stream of new triples."""
