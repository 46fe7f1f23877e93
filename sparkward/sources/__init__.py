"""Readers that turn trees, tables and tool output into DataFrames."""
