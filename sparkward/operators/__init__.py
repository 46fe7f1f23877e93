"""Relational operators over findings, lines and files."""
