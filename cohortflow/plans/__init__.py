"""Registered queries, grouped by operator family."""
