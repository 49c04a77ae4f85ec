"""Continuous forms: run records and file states as streams."""
