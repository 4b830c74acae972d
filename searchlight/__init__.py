"""Searchlight: search and web-traffic analytics as plain Spark jobs."""
