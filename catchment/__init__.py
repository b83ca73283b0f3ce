"""Emission accounting over facility and city tables, written as Spark jobs."""
