"""Whole queries from source to result."""
