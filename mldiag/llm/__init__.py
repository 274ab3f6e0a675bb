"""Operators for large text corpora: deduplication, quality, mixing, tokens, shards, languages, licences."""
