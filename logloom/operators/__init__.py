"""Relational operators over the calls table."""
