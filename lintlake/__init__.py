"""Lint a whole organisation's SQL as tables: source files and query logs in, findings out."""
