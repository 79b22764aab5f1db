"""Readers, parsers and table maintenance."""
