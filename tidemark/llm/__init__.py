"""Operators for training text: deduplication, mixing, language, search, redaction, chat, shards, sketches, tokens."""
