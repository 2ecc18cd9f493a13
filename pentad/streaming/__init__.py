"""Scoring of streams against a fixed reference set."""
