"""Extraction over streams."""
