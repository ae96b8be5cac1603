"""Operators bound to the given tables, each with the SQL that must return the same rows."""
