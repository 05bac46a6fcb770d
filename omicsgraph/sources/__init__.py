"""Readers, parsers of text lines, and writers."""
