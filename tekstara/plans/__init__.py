"""Composite dataflows and the catalogue of queries."""
