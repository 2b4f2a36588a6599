"""Structured Streaming over arriving batches."""
