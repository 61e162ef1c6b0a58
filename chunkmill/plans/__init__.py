"""Repositories and the catalogue of queries."""
