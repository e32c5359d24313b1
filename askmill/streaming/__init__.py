"""Keeping the index in step with the chunk table."""
