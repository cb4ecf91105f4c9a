"""Operators for preparing language-model training data: deduplication, sharding, packing, audits, text rules."""
