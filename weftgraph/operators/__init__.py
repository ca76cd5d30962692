"""Operators on triples, types, patterns, rules, rankings and scores; all return DataFrames."""
