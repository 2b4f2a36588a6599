"""Readers: payloads, text, JSON and word-processor files, and a corpus of invented notes."""
