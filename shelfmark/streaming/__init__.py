"""Streaming versions of the logs and of the keyed merges."""
