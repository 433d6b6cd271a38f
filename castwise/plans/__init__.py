"""Composed plans: derived tables and the registered queries with their SQL twins."""
