"""Operators of a training-data pipeline: rules, duplicates, toxicity, personal data, packing, tokens, languages."""
