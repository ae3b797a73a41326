"""Operators for training data: filtering, deduplication, tokens, chat records and shards."""
