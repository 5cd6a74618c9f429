"""DataFrame operators and reports."""
