"""Operators for preparing training data: extraction, deduplication, language, privacy, tokens, packing."""
