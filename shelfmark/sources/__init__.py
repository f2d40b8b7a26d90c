"""Readers, writers and the adapters over the sample tables."""
