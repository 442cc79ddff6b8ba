"""Declarative queries and the plans they make."""
