"""Operators on the structure of values and over rows."""
