"""Hashes, encodings, compression and encryption of columns."""
