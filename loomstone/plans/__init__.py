"""Declarative extraction, compiled to columns."""
