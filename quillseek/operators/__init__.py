"""Filters, aggregations and sorts as native DataFrame operations."""
