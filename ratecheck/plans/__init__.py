"""Whole audit plans, reports, and the query catalog over the driver tables."""
