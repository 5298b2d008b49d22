"""Queries: operators applied to tables, and their SQL."""
