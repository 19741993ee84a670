"""Queries over the given tables, each registered with the SQL that gives the same rows."""
