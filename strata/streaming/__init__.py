"""Continuous imports from file drops."""
