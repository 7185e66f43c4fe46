"""Queries: decision support, applications, single operators."""
