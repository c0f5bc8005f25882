"""Relational operators over the catalog tables."""
