"""Operators over whole tables: monitoring, learning, changes, search, workflows."""
