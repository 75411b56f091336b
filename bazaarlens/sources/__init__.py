"""Readers of feeds and tables, and report sinks."""
