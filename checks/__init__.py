"""Inputs made from the given tables, and the SQL that recomputes each query."""
