"""Operators on panels, grouped by subject."""
