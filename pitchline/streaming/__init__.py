"""Structured Streaming over match events."""
