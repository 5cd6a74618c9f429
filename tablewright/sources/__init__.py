"""Readers, layers and data sources."""
