"""Readers, writers, the star-join extracts and the synthetic generator."""
