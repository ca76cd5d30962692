"""Column functions: knowledge-graph embedding scores and small parsers."""
