"""Operators on tables: extraction, joins, windows, layout, scoring."""
