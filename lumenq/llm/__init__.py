"""Operators for training text: filters, near duplicates, mixing, scoring, packing and sharding."""
