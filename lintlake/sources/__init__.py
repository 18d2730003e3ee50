"""Readers, file filters and the result store."""
