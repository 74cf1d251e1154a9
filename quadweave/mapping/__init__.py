"""Mapping of the knowledge-graph engine."""
