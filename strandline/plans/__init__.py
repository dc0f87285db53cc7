"""Queries over the driver tables, with their SQL."""
