"""Readers of tables, feeds, pages and stored knowledge."""
