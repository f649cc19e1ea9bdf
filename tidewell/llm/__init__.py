"""Operators for building training corpora: sharding, rules, dedup, mixing, tokens, classifiers, near duplicates."""
