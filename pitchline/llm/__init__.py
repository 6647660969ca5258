"""Operators that prepare training text: filtering, deduplication, mixing, scoring and packing on Spark."""
