"""Composite jobs (named report sections), and the registry of queries."""
