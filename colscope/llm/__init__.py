"""Operators for preparing training corpora: mixing, search, deduplication, tokens, quality, language, licences."""
