"""Operators for preparing training text: filtering, deduplication, packing, formatting, tokenising."""
