"""Operators on streams, chunks, bundles and repositories."""
