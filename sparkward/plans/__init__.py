"""Whole query plans and the helpers they share."""
