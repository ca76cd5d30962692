"""Readers and writers of the text formats that knowledge-graph data comes in."""
