"""Loads that continue where the last one ended."""
