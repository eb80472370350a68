"""Versioned key-value analytics on Spark: an append-only log of changes, resolved on read."""
