"""Incremental intake of new source files."""
