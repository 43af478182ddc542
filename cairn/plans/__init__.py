"""Registered queries over the driver tables, with the same query in SQL."""
