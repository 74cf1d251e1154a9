"""Plans of the knowledge-graph engine."""
