"""DataFrame operators of record extraction."""
