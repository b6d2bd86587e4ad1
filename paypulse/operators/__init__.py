"""Relational operators: landing, unpacking, upsert, metrics, health."""
