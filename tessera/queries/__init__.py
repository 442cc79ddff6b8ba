"""Registered queries of the extraction operators, with their SQL."""
