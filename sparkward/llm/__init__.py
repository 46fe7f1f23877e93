"""Operators for preparing training data: search, near-duplicates, quality, packing, tokens, chat."""
