"""Watching and incremental runs."""
