"""DataFrame operators, grouped by business question."""
