"""Operators for large training corpora; registered by ``__spark_entry__`` when present."""
