"""Readers of what has landed."""
