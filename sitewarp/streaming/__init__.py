"""Incremental and windowed views of the same tables."""
