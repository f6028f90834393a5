"""Readers: file inventory, CSV files, nested invoice records."""
