"""Readers of files, pages and stored tables."""
