"""Queries over the driver tables and the SQL that states the same results."""
