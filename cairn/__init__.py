"""Indexed, read-mostly catalogs on Spark."""
