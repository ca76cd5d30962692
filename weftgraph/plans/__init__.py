"""Compositions of operators: scans, producer rounds, and the registered queries."""
