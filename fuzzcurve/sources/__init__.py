"""Readers of curve tables and small generated tables."""
