"""Operators over captured execution plans."""
